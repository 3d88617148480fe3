import itertools
import random

import duckdb
import pytest

from sylvanite.functions import kernels as k
from sylvanite.functions import structure
from sylvanite.operators import generators, measures, mining
from sylvanite.plans import bridge, catalog
from sylvanite.sources import graphs as io

SF = "/root/testdata/sf0.001"
K4 = [(a, b) for a in range(4) for b in range(a + 1, 4)]
K23 = [(a, b) for a in (0, 1) for b in (2, 3, 4)]


def test_measures_of_known_graphs():
    assert k.measures(0, [])["connected"] == 1 and k.measures(0, [])["max_degree"] == -1
    assert k.measures(2, [])["components"] == 2
    m = k.measures(4, K4)
    assert m["spanning_trees"] == 16 and m["outerplanar"] == 0 and m["simple_cycles"] == 7
    assert k.measures(5, K23)["outerplanar"] == 0
    square = k.measures(4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)])
    assert square["outerplanar"] == 1 and square["spanning_trees"] == 8 and square["cactus"] == 0
    two = k.measures(5, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)])
    assert two["cactus"] == 1 and two["blocks"] == 2 and two["max_block_degree"] == 2
    quirk = k.measures(4, [(0, 1), (1, 2), (0, 2)])
    assert quirk["path"] == 1 and quirk["tree"] == 0


def test_spanning_trees_against_enumeration():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 6)
        e = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]
        assert k.spanning_trees(n, e) == k.brute_spanning_trees(n, e)
        if len(set(k.component_ids(n, e))) == 1:
            tree = k.wilson(n, e, r)
            assert len(tree) == n - 1 and set(tree) <= set(e)


def test_canonical_strings_do_not_depend_on_numbering():
    r = random.Random(2)
    for _ in range(40):
        n = r.randint(1, 8)
        e = [(r.randrange(v), v, str(r.randrange(2))) for v in range(1, n)]
        labels = [str(r.randrange(12)) for _ in range(n)]
        p = list(range(n))
        r.shuffle(p)
        moved = [None] * n
        for v in range(n):
            moved[p[v]] = labels[v]
        s = k.free_string(labels, e)
        assert s == k.free_string(moved, [(p[a], p[b], x) for a, b, x in e])
        back = k.parse_string(s)
        assert k.free_string(*back) == s and k.contains(labels, e, *back)


def test_user_graphs_hold_late_events(spark, tmp_path):
    kinds = ["a", "b"] * 6 + ["c", "a", "d", "c"]
    spark.createDataFrame([(k, 7, t, k) for k, t in enumerate(kinds)], "event_id long, user_id long, event_type string, ts long").write.parquet(str(tmp_path / "events.parquet"))
    g = bridge.graphs(spark, str(tmp_path), "user").first()
    pairs = {tuple(sorted((g.vlabels[e.src], g.vlabels[e.dst]))) for e in g.edges}
    assert pairs == {tuple(sorted(x)) for x in zip(kinds, kinds[1:])} and list(g.vlabels) == ["a", "b", "c", "d"]


def test_text_round_trip(spark, tmp_path):
    g = generators.random_graphs(spark, 20, 5, 0.4, seed=3)
    io.write_graphs(g, str(tmp_path / "db"))
    back = io.read_graphs(spark, str(tmp_path / "db"))
    order = lambda d: sorted((r.asDict(True) for r in d.collect()), key=lambda x: x["graph_id"])
    assert order(back) == order(g)


def test_malformed_records_are_left_out(spark, tmp_path):
    (tmp_path / "db").write_text("# 1 -1 2 1\na b\n1 2 x\n# 2 0 2 1\na\n1 2 x\n# z 0 1 0\na\n\n# 3 0 1 0\nb\n\n$\n")
    assert sorted(r.graph_id for r in io.read_graphs(spark, str(tmp_path / "db")).collect()) == [1, 3]


def test_mining_against_brute_force(spark):
    g = generators.random_trees(spark, 12, 6, labels=2, seed=5)
    found = {r.cstring: r.support for r in mining.frequent_subtrees(g, 6, 4).collect()}
    rows = g.collect()
    for c, s in found.items():
        p = k.parse_string(c)
        assert s == sum(k.contains(r.vlabels, [(e.src, e.dst, e.label) for e in r.edges], *p) for r in rows) >= 6
    f = mining.features(g, sorted(found))
    assert f.count() == 12 and mining.sketch(f, [[0, 1], [1, 0]]).count() == 12


def test_measure_filter(spark):
    g = generators.random_trees(spark, 10, 5)
    assert measures.filter_graphs(g, "tree", "==", 1).count() == 10
    assert measures.filter_graphs(g, "numberOfEdges", "<", 4).count() == 0
    assert measures.sampled_trees(g, 2).count() == 20


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "conversations", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(str, a[columns].values.tolist())) == sorted(map(str, b[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_paths_are_mined_to_their_end(spark, tmp_path):
    spark.createDataFrame([(c, t, "uas"[t % 3]) for c in range(3) for t in range(6)], "conv_id long, turn long, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    q = catalog.queries()
    assert max(r["size"] for r in q["mine_subtree"](spark, str(tmp_path)).collect()) == 6
    assert max(len(k.parse_string(r.cstring)[0]) for r in q["postings_conv"](spark, str(tmp_path)).collect()) == 6


def test_orders_of_any_size_have_a_string(spark):
    got = catalog.queries()["star_strings_order"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_cycles_are_not_cut():
    full = lambda n: [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert sum(1 for _ in itertools.islice(k.simple_cycles(11, full(11)), 1_000_001)) == 1_000_001
    assert len(structure.all_hamiltonian_rings(8, full(8))) == 2520
