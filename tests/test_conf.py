"""Scenario configuration readers (quoted multi-line fields, wide matrices) and the hierarchy built from them."""

import os
import tempfile

from indexspark.plans.hierarchy import sunburst_weights
from indexspark.sources.conf import read_conf
from indexspark.sources.layers import catalog_frame


def _conf_dir():
    d = tempfile.mkdtemp(prefix="indexspark-conf-")
    files = {
        "goals.csv": (
            'order_color,order_hierarchy,order_calculate,goal,parent,name,name_flower,description,weight,preindex_function,postindex_function\n'
            '1.2,1,3,FP,,Food Provision,Food,"Seafood, sustainably ""harvested""\nacross two lines",1,,"FP(layers, scores)"\n'
            '1.1,1.1,1,FIS,FP,Fisheries,Fish,"Wild catch",0.5,"FIS(layers, status_year=2011)",\n'
            '1.3,1.2,2,MAR,FP,Mariculture,Mar,Farms,0.5,"MAR(layers, status_year=2013)",\n'
            '2,2,4,AO,,Artisanal,AO,Access,1,"AO(layers, status_year=2013)",\n'
        ),
        "dimensions.csv": 'dimension,description\nstatus,"current value, relative"\ntrend,slope\n',
        "pressures_matrix.csv": "goal,element,element_name,po_a,po_b\nFIS,,,1,\nAO,,,,3\nMAR,x1,name,2,2\n",
        "resilience_matrix.csv": "goal,element,r_a,r_b\nFIS,,x,\nAO,,,x\n",
        "pressure_categories.csv": "layer,category,subcategory\npo_a,ecological,pollution\npo_b,social,social\n",
        "resilience_categories.csv": "layer,category,category_type,subcategory,weight\nr_a,ecological,ecosystem,ecological,1\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    return d


def test_read_conf_and_sunburst(spark):
    conf = read_conf(spark, _conf_dir())
    goals = conf["goals"]
    fp = goals.where("goal = 'FP'").collect()[0]
    assert goals.count() == 4 and "\n" in fp.description and '"harvested"' in fp.description and fp.weight == 1.0
    assert conf["dimensions"].count() == 2
    pm = {(r.goal, r.layer, r.weight) for r in conf["pressures_matrix"].collect()}
    assert pm == {("FIS", "po_a", 1.0), ("AO", "po_b", 3.0), ("MAR", "po_a", 2.0), ("MAR", "po_b", 2.0)}
    assert {(r.goal, r.layer) for r in conf["resilience_matrix"].collect()} == {("FIS", "r_a"), ("AO", "r_b")}
    cat = catalog_frame(spark, [dict(layer="l1", targets="FIS"), dict(layer="l2", targets="AO")])
    w = {r.path: (r.category, r.layer_weight) for r in sunburst_weights(goals, cat, conf["pressures_matrix"], conf["resilience_matrix"]).collect()}
    assert w["FP-FIS-s_l1"] == ("status", 0.5 / 3)  # FIS leaves: s_l1, p_po_a, r_r_a
    assert w["AO-AO-p_po_b"] == ("pressure", 1.0 / 3)
    assert abs(sum(v for k, (_, v) in w.items() if k.startswith("FP-MAR")) - 0.5) < 1e-12
