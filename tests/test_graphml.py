"""GraphML source on a single hand-written street-network file."""

import os
import tempfile

from courierflow.sources.graphml import read_graphml

DOC = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d10" for="edge" attr.name="length" attr.type="double"/>
  <key id="d3" for="node" attr.name="street_count" attr.type="long"/>
  <key id="d5" for="node" attr.name="x" attr.type="double"/>
  <key id="d4" for="node" attr.name="y" attr.type="double"/>
  <key id="d9" for="edge" attr.name="name" attr.type="string"/>
  <graph edgedefault="directed">
    <node id="101"><data key="d4">-23.55</data><data key="d5">-46.63</data><data key="d3">3</data></node>
    <node id="102"><data key="d5">-46.64</data><data key="d4">-23.56</data></node>
    <edge source="101" target="102" id="0"><data key="d9">Rua A</data><data key="d10">1523.4</data></edge>
    <edge source="102" target="101" id="0"><data key="d10">1600.0</data></edge>
  </graph>
</graphml>
"""


def test_single_file_street_graph(spark):
    folder = tempfile.mkdtemp(prefix="cf-graphml-")
    path = os.path.join(folder, "city.graphml")
    with open(path, "w") as fh:
        fh.write(DOC)
    node, edge = read_graphml(spark, path)
    assert sorted(tuple(r) for r in node.collect()) == [(101, -23.55, -46.63), (102, -23.56, -46.64)]
    assert sorted(tuple(r) for r in edge.collect()) == [(101, 102, 1523.4), (102, 101, 1600.0)]
