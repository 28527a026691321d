"""Cell libraries, ports and aliases of netlists, connected components, and activity of pins."""

import random

from axonwave.operators.graphs import components
from axonwave.sources import files, netlist

LIBRARY = """library (x) { /* cell (no) { } */
  cell ("buf_1") { area : 3.75; pin (A) { direction : "input"; capacitance : 1; } pin ("X") { function : "A"; direction : "output"; } }
  cell (dff) { area: 20.0; pin (CLK) { clock : true; direction : input; } pin(D) { direction : input; } pin (Q) { direction : output; } pin (QN) { direction : output; } }
  cell (tie) { pin (HI) { direction : output; } } }"""
DESIGN = """module top(a, clk, y, z); // a comment; with .A(nothing)
  input [1:0] a; input clk; output y; output wire [2:1] z;
  wire w1; /* assign no = no2; */
  buf_1 u1 ( .A(a[0]), .X(w1) );
  buf_1 \\u2[0] ( .A(\\w1 ), .X(n2) );
  dff u3 (.CLK(clk), .D(m2), .Q(q), .QN());
  tie t1 (.HI(one)); buf_1 u4 (.A(1'b0), .X(z[1]));
  assign m1 = n2;
  assign m2 = m1; assign y = q; assign z[2] = 1'b1;
endmodule"""


def test_design(spark, tmp_path):
    (tmp_path / "x.lib").write_text(LIBRARY)
    (tmp_path / "x.v").write_text(DESIGN)
    lib = netlist.read_liberty(spark, str(tmp_path / "x.lib"))
    assert {(r.cell, r.area, r.pin, r.output) for r in lib.collect()} == {
        ("buf_1", 3.75, "A", False), ("buf_1", 3.75, "X", True), ("dff", 20.0, "CLK", False), ("dff", 20.0, "D", False), ("dff", 20.0, "Q", True), ("dff", 20.0, "QN", True), ("tie", 0.0, "HI", True)}
    v = str(tmp_path / "x.v")
    assert {(r.port, r.output) for r in netlist.read_ports(spark, v).collect()} == {("a[0]", False), ("a[1]", False), ("clk", False), ("y", True), ("z[1]", True), ("z[2]", True)}
    assert {(r.a, r.b) for r in netlist.read_aliases(spark, v).collect()} == {("m1", "n2"), ("m2", "m1"), ("y", "q")}
    g = netlist.read_design(spark, v, lib)
    got = {(r.net, r.inst.lstrip("\\"), r.pin, r.to_inst.lstrip("\\"), r.to_pin) for r in netlist.connections(g).collect()}
    assert got == {("a[0]", "", "a[0]", "u1", "A"), ("w1", "u1", "X", "u2[0]", "A"), ("m1", "u2[0]", "X", "u3", "D"), ("clk", "", "clk", "u3", "CLK"), ("q", "u3", "Q", "", "y"), ("z[1]", "u4", "X", "", "z[1]")}
    (tmp_path / "d.vcd").write_text("$var wire 1 ! m2 $end\n$var wire 1 % w1 $end\n$var wire 1 & n2 $end\n#0\n0!\n0%\n0&\n#5\n1!\n1%\n1&\n#9\n0%\nx!\n")
    act = netlist.pin_activity(files.read_vcd(spark, str(tmp_path / "d.vcd")), g, netlist.read_aliases(spark, v))
    assert {(r.inst.lstrip("\\"), r.pin): r.toggles for r in act.collect()} == {("u1", "X"): 2, ("u2[0]", "X"): 1, ("u3", "Q"): 0, ("t1", "HI"): 0, ("u4", "X"): 0, ("", "a[0]"): 0, ("", "a[1]"): 0, ("", "clk"): 0}


def test_components(spark):
    r = random.Random(3)
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(90)] + [(f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(60)] + [("hub", f"h{k}") for k in range(40)] + [("same", "same"), (None, "y")]
    near = {}
    for a, b in pairs:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            todo += [m for m in near[todo.pop()] if m not in seen and not seen.add(m)]
        want[n] = min(seen)
    assert {x.node: x.rep for x in components(spark.createDataFrame(pairs, "a string, b string").repartition(3)).collect()} == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
