import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sylvanite.functions import embedding as em
from sylvanite.functions import kernels as k
from sylvanite.operators import evaluation as ev
from sylvanite.operators import generators as gen
from sylvanite.operators import measures, mining, pattern_kernels as pk
from sylvanite.sources import formats as fm
from sylvanite.sources import graphs as io
from sylvanite.streaming import graph_stream as gs


def test_generators_are_seeded_and_sound(spark):
    every = {
        "preferential": gen.preferential(spark, 4, 9, 2, seed=1), "mixed": gen.preferential(spark, 4, 9, 2, 0.95), "overlap": gen.geometric(spark, 4, 12, 0.4),
        "clusters": gen.geometric(spark, 4, 12, 0.2, clusters=3), "moving": gen.moving(spark, 2, 3, 10, 0.4, 0.1), "chains": gen.chains(spark, 4, 3, 5, 0.5),
    }
    for name, g in every.items():
        a, b = ([r.asDict(True) for r in g.orderBy("graph_id").collect()] for _ in range(2))
        assert a == b and a, name
        assert all(r["n"] == len(r["vlabels"]) and r["m"] == len(r["edges"]) and all(0 <= e["src"] < e["dst"] < r["n"] for e in r["edges"]) for r in a), name
    assert all(r.m == 3 + 6 * 2 for r in every["preferential"].collect())
    assert measures.filter_graphs(every["chains"], "outerplanar", "==", 1).count() == 4
    assert measures.filter_graphs(every["chains"], "numberOfBlocks", "==", 3).count() == 4
    assert measures.filter_graphs(gen.joined_up(gen.random_graphs(spark, 5, 6, 0.1)), "minDegree", ">=", 1).count() == 5
    assert gen.geometric(spark, 2, 5, 0.0).where("m > 0").count() == 0


def test_near_pairs_against_all_pairs():
    r = random.Random(1)
    points = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(60)]
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if sum((x - y) ** 2 for x, y in zip(points[a], points[b])) < 0.09}
    assert {e[:2] for e in gen.near_pairs(points, 0.3)} == near


def test_cyclic_patterns_and_their_numbers(spark):
    g = gen.random_graphs(spark, 8, 5, 0.5, seed=3).cache()
    strings = pk.cyclic_patterns(g)
    known, rows = pk.feature_rows(strings)
    numbers = {r.feature: r.cstring for r in known.collect()}
    assert sorted(numbers) == list(range(1, len(numbers) + 1)) and list(map(numbers.get, sorted(numbers))) == sorted(numbers.values())
    total = {r.graph_id: sum(f.occurrences for f in r.features) for r in rows.collect()}
    for r in pk.counts(g).collect():
        assert total[r.graph_id] == r.cycles + r.trees
        m = k.measures(r.n, [(e.src, e.dst) for e in g.where(F.col("graph_id") == r.graph_id).first().edges])
        assert (r.cycles, r.trees) == (m["simple_cycles"], m["bridge_trees"])
    assert pk.count_lines(rows).count() == 8
    assert pk.cyclic_patterns(g, "trees").where("cstring like '(%'").count() == 0


def test_outerplanar_patterns_triples_and_reports(spark):
    g = gen.chains(spark, 3, 2, 4, 0.5, seed=2).cache()
    assert pk.outerplanar_patterns(g, 1).count() > 0 and pk.outerplanar_patterns(g, 2, True).count() > 0
    assert all(r.features == sorted(set(r.features)) for w in (True, False) for r in pk.triples(g, w).collect())
    for r in pk.reports(g).collect():
        x = json.loads(r.value)
        assert x["graph"] == r.graph_id and x["isOuterplanar"] and len(x["ccs"][0]["blocks"]) == 2


def test_fingerprints_never_lose_a_subset(spark):
    d = spark.createDataFrame([([1, 5], [1, 5, 33]), ([2], [3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(pk.maybe_subset(pk.fingerprint("a"), pk.fingerprint("b"))).collect()] == [True, False, True]


def test_text_formats(spark, tmp_path):
    (tmp_path / "one").write_text("3 2\n0 a\n1 b\n2 c\n1 0 x\n1 2 y\n")
    r = fm.read_simple(spark, str(tmp_path / "one")).first()
    assert (r.n, r.m, list(r.vlabels)) == (3, 2, ["a", "b", "c"]) and (r.edges[0].src, r.edges[0].dst) == (0, 1)
    assert fm.read_simple(spark, str(tmp_path / "one"), True).first().edges[0].src == 1
    (tmp_path / "blocks").write_text("# 7 2\n3\t1\ta \n2\t2\ta ( x b ) \n# 8 1\n1\t1\tb \n")
    blocks = fm.read_blocks(spark, str(tmp_path / "blocks"))
    assert sorted((r.graph_id, r.pattern_id, r.support, r.cstring) for r in blocks.collect()) == [(7, 1, 3, "a "), (7, 2, 2, "a ( x b ) "), (8, 1, 1, "b ")]
    assert sorted(r.value for r in fm.pattern_lines(blocks, 1).collect()) == ["2\t1\tb ", "3\t2\ta ( x b ) ", "4\t1\ta "]
    (tmp_path / "svm").write_text("# head\n1 2:2.5 10:-5.2 # tail\n2 5:1\n3\n")
    rows = fm.read_sparse(spark, str(tmp_path / "svm"))
    assert sorted(r.value.strip() for r in fm.sparse_text(rows).collect()) == ["1 2:2.5 10:-5.2", "2 5:1", "3"]
    (tmp_path / "bad").write_text("python 2:2.5\n")
    with pytest.raises(Exception, match="not a sparse feature line"):
        fm.read_sparse(spark, str(tmp_path / "bad")).collect()
    d = spark.createDataFrame([("1",), ("63",), ("0",), ("99",), ("x",)], "c string")
    assert [r[0] for r in d.select(fm.element("c")).collect()] == ["H", "AC", "ERR", "ERR", "ERR"]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(g, f) for g in range(40) for f in (1, 2 + g % 2, 4 + g % 3)], "graph_id long, feature int")
    targets = spark.createDataFrame([(g, 1 + g % 2) for g in range(40)], "graph_id long, activity long")
    rows = ev.svm_rows(pairs, targets).cache()
    stat = {r["index"]: r.statistic for r in ev.chi_squared(rows).collect()}
    assert stat[1] == pytest.approx(0) and stat[2] == pytest.approx(20) and stat[3] == pytest.approx(20)
    # 34 % of six features are three, rounded up; 5 and 6 tie for the third place
    assert stat[5] == pytest.approx(stat[6]) and {f["index"] for r in ev.top_features(rows, 34).collect() for f in r.features} == {2, 3, 5}
    some, rest = ev.subset(rows, 10), ev.subset(rows, 10, complement=True)
    assert some.count() == 10 and rest.count() == 30 and some.join(rest, "graph_id").count() == 0 and some.where("label = 1").count() == 5
    both = ev.merged(rows, rows)
    assert all(len(r.features) == 6 and len({f["index"] for f in r.features}) == 6 for r in both.collect())
    data = ev.vectors(rows, 8).withColumn("label", F.col("label") - 1)
    out = ev.train(data, (1.0,), 2).transform(data)
    assert ev.errors(out).first().accuracy == 1.0
    assert ev.area_under_curve(spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, label int")) == pytest.approx(0.875)
    assert ev.geometric_mean(spark.createDataFrame([(1.0,), (4.0,)], "x double"), "x").first()["mean"] == pytest.approx(2)
    assert ev.best_cells(rows.select("graph_id"), "graph_id", 2).count() == 2
    assert ev.frequent_pairs(pairs, spark.createDataFrame([(1,)], "feature int")).count() == 40
    coded = targets.select(*(ev.changed_label(h).alias(h) for h in ("AvsI", "AvsMI", "AMvsI"))).distinct().collect()
    assert {tuple(r) for r in coded} == {(None, -1, 1), (1, 1, 1)}


def test_streamed_filter_is_the_batch_filter(spark, tmp_path):
    g = gen.random_graphs(spark, 12, 5, 0.5, seed=8).cache()
    io.write_graphs(g, str(tmp_path / "in"))
    kept = gs.stream_filter(gs.stream_graphs(spark, str(tmp_path / "in")), "numberOfSimpleCycles", ">=", 1)
    gs.write(kept, str(tmp_path / "out"), str(tmp_path / "ck"), wait=True)
    batch = {r.graph_id for r in measures.filter_graphs(g, "numberOfSimpleCycles", ">=", 1).collect()}
    assert {r.graph_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    with pytest.raises(ValueError):
        gs.stream_filter(g, "count")
    assert gs.stream_support(g).count() > 0


def test_shared_branches_answer_as_the_plain_test():
    r = random.Random(5)
    for turn in range(60):
        n = r.randrange(1, 9)
        edges = [(a, b, r.choice("xy")) for b in range(1, n) for a in [r.randrange(b)] if r.random() < 0.9]
        if turn % 3 == 0 and n > 3:
            edges = sorted({(0, 3, "x"), (0, 1, "x"), (1, 3, "y"), (1, 2, "x")})
        labels = [r.choice(["a", "b", None]) for _ in range(n)]
        shared = em.Shared(labels, edges)
        for _ in range(10):
            k_ = r.randrange(0, 5)
            pattern = [r.choice(["a", "b", None]) for _ in range(k_)], [(r.randrange(b), b, r.choice(["x", "y", None])) for b in range(1, k_)]
            assert shared.holds(*pattern) == em.subtree(labels, edges, *pattern), (labels, edges, pattern)
    star = em.Shared(["c", "a", "a", "b"], [(0, 1, "x"), (0, 2, "x"), (0, 3, "x")])
    assert star.holds(["c", "a"], [(0, 1, "x")])
    before = set(star.known)
    assert star.holds(["c", "a", "a"], [(0, 1, "x"), (0, 2, "x")])
    assert {key[0] for key in set(star.known) - before} == {("c", (("x", ("a", ())), ("x", ("a", ()))))}  # the leaf is known


def test_mining_root_by_root_is_mining(spark):
    r, rows = random.Random(3), []
    for x in range(8):
        edges = [{"src": r.randrange(b), "dst": b, "label": "1"} for b in range(1, 6)]
        rows.append((x, 0, 6, 5, [r.choice("ab") for _ in range(6)], edges))
    g = spark.createDataFrame(rows, io.GRAPH).cache()
    plain, by_root = (m(g, 2, 4, name="rootedTrees") for m in (mining.mine, mining.mine_by_root))
    rows = [sorted((r["size"], r.cstring, r.support) for r in x[0].collect()) for x in (plain, by_root)]
    assert rows[0] == rows[1] and max(r[0] for r in rows[0]) > 1
    held = [sorted((r.cstring, r.graph_id, r.found) for r in x[1].join(x[0], "pattern_id").collect()) for x in (plain, by_root)]
    assert held[0] == held[1]
    assert mining.mine_by_root(g, 100, 4)[0].count() == 0
    with pytest.raises(ValueError):
        mining.mine(g, 2, 3, "subtree", roots=["a"])
    with pytest.raises(ValueError, match="forests only"):
        em.rooted_subtree(["a"] * 3, [(0, 1, "1"), (0, 2, "1"), (1, 2, "1")], ["a"], [])


def _brute_sessions(events):
    out = []
    for user in {e[1] for e in events}:
        own = sorted((ts, k, kind) for k, u, ts, kind in events if u == user)
        runs = [[own[0]]]
        for e in own[1:]:
            if (e[0] - runs[-1][-1][0]).total_seconds() > 12 * 3600:
                runs.append([])
            runs[-1].append(e)
        for run in runs:
            kinds = [e[2] for e in run]
            names = sorted(set(kinds))
            links = {tuple(sorted((names.index(a), names.index(b)))) for a, b in zip(kinds, kinds[1:]) if a != b}
            out.append((user, run[0][0], names, sorted(links)))
    return sorted(out)


def test_session_graphs_of_a_stream_with_late_events(spark, tmp_path):
    r, day = random.Random(2), dt.datetime(2024, 1, 1)
    events = [(k, r.randrange(4), day + dt.timedelta(minutes=r.randrange(7 * 1440)), r.choice(["view", "click", "buy"])) for k in range(150)]
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    for name, rows in (("1", events), ("2", [(999, 9, day + dt.timedelta(days=30), "view")]), ("3", [(1000, 1, day + dt.timedelta(days=1), "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        gs.write(gs.session_graphs(stream), str(tmp_path / "out"), str(tmp_path / "ck"), wait=True)
    got = sorted((x.user_id, x.start, list(x.vlabels), sorted((e.src, e.dst) for e in x.edges)) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == _brute_sessions(events)  # the late event comes to nothing, the last session is still open
    table = spark.createDataFrame([*events, (1001, None, day, "x"), (1002, 1, None, "x")], schema)
    assert sorted((x.user_id, x.start) for x in gs.session_graphs(table).collect()) == [x[:2] for x in _brute_sessions(events)]
    assert gs.session_graphs(table.limit(0)).count() == 0


def test_windowed_support(spark):
    day = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(day + dt.timedelta(hours=h), "a") for h in (0, 5, 6)], "ts timestamp, event_type string")
    assert sorted((x.start, x.events) for x in gs.windowed_support(e).collect()) == [(day, 2), (day + dt.timedelta(hours=6), 1)]
    assert sum(x.events for x in gs.windowed_support(e, "6 hours", "3 hours").collect()) == 6


def test_lines_of_numbers_and_whole_noise(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, []), (3, None)], "id int, x array<int>")
    assert [r.value for r in io.array_lines(df.where("id < 3"), "x", "id").collect()] == ["1 3 1", "2 "]
    assert [r.value for r in io.array_lines(df, "x", sparse=True).collect()] == ["1:1 3:1", "", ""]
    moved = spark.range(4000).select(gen.integer_noise("id", 10.0).alias("y"), "id").toPandas()
    d = moved.y - moved.id
    assert abs(d.mean()) < 1 and 8 < d.std() < 11
