"""Text, JSON, merging, the terminal, the event log and streams."""

import pytest
from pyspark.sql import functions as F

from credence.cli import Terminal
from credence.engine import Engine
from credence.plans import syntax
from credence.sources.kb import DuplicateDeclaration, KnowledgeBase
from credence.sources.log import EventLog, Materialization, MemoryRepository, Repository
from credence.streaming.ingest import ingest

PROGRAM = """
% what a small harbour knows
pred feeds/2 @{description:"feeds(Source, Sink)"}.
pred draught/2 [vessel, int].
feeds(canal, 'Mill\\'s basin') @{b:0.85, src:survey, et:"2022-05-04T00:00:00Z"}.
draught(barge, 2.25) @{et:"2022-05-04T00:00:00Z"}. built(barge, d"1931-07-19") @{et:"2022-05-04T00:00:00Z"}.
sailed(barge, dur"P3DT4H") @{et:"2022-05-04T00:00:00Z"}. moored(barge, dt"2022-05-04T17:45:00Z", "quay \\"east\\"") @{et:"2022-05-04T00:00:00Z"}.
about(feeds/2) @{et:"2022-05-04T00:00:00Z"}.
deep(X) :- draught(X, Y), gt(Y, 2), not feeds(_, X) @{b:0.75, et:"2022-05-04T00:00:00Z"}.
!:- deep(X), feeds(X, _) @{b:0.35, et:"2022-05-04T00:00:00Z"}.
"""


def same(a, b):
    return (a.facts, a.rules, a.constraints, a.predicates) == (b.facts, b.rules, b.constraints, b.predicates)


def test_round_trips():
    kb = KnowledgeBase.parse(PROGRAM)
    assert KnowledgeBase.parse(kb.render()).render() == kb.render()
    assert same(KnowledgeBase.from_json(kb.to_json()), kb)


def test_json_repair():
    text = '{"statements": [{"atom": {"pred": "p", "args": [{"value": "a"}, {"value": 3}]}}, {"head": {"pred": "q", "args": [{"name": "X"}]}, "goals": [{"atom": {"pred": "p", "args": [{"name": "X"}, {"name": "Y"}]}}]}]}'
    with pytest.raises(KeyError):
        KnowledgeBase.from_json(text)
    kb = KnowledgeBase.from_json(text, fix=True)
    assert kb.facts[0].atom.render() == "p(a, 3)" and len(kb.rules) == 1


@pytest.mark.parametrize("text", ["p(X).", "p(f(a)).", "p(a)", "p(a) @{b:1.5}.", "q(X) :- not gt(X, 1).", "pred badarity.", "pred p/0.", "pred p/2 [a].", "pred p/1 @{b:1}.", "not(a).", "p(a) @{b:1, b:1}."])
def test_bad_programs(text):
    with pytest.raises(ValueError):
        KnowledgeBase.parse(text)


@pytest.mark.parametrize("text", ["?- p(X) @{nonsense:1}.", "?- assume(not p(a)), p(X).", "?- p(X) @{limit:-1}.", "?- p(X) @{max_depth:0}.", "?- gt(X).", "?- p(X) @{focus:luck}."])
def test_bad_queries(text):
    with pytest.raises(ValueError):
        syntax.query(text)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "latin-1"])
def test_encodings(tmp_path, encoding):
    path = tmp_path / "x.txt"
    path.write_bytes('p("Zoë").\n'.encode(encoding))
    assert KnowledgeBase.load(str(path)).facts[0].atom.args[0].value == "Zoë"


def test_merge_and_unload():
    kb = KnowledgeBase.parse('pred p/1. p(a) @{et:"2026-01-01T00:00:00Z"}. q(X) :- p(X).')
    assert len(kb.merge(KnowledgeBase.parse('p(a) @{et:"2026-01-01T00:00:00Z"}.')).facts) == 1
    assert len(kb.merge(KnowledgeBase.parse('p(a) @{b:0.5, et:"2026-01-01T00:00:00Z"}.')).facts) == 2
    with pytest.raises(DuplicateDeclaration):
        kb.merge(KnowledgeBase.parse("pred p/1."))
    left, counts = kb.unload_predicate("p", 1)
    assert counts == {"declaration": 1, "fact": 1, "rule": 1, "constraint": 0} and not left.facts
    assert kb.unload_entity("a")[1] == 1


def test_macros(tmp_path, monkeypatch):
    (tmp_path / "mymacros.py").write_text("MACROS = {'both': lambda text: [f'{n}({text.split()[1]})' for n in text.split()[2:]]}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    kb = KnowledgeBase.parse('use templates "mymacros" [both as twice]. twice x p q.')
    assert [f.atom.render() for f in kb.facts] == ["p(x)", "q(x)"]


def test_terminal(spark):
    said = []
    t = Terminal(Engine(spark), say=said.append)
    lines = ["pred item/1.", "item(x).", "% nothing", "item(", "y).", '?- item(X) @{order_by:"X"}.', "pred item/1.", "pred bad.", "?- item(z).", "?- nothing(X).", "/- unload predicate item/1", "/- info", "/- nonsense", "/- unload all", "/- dump", "/- exit"]
    assert [t.line(x) for x in lines] == [True] * 15 + [False]
    assert said[0] == "  Added: 1 predicate(s)" and said[1] == "  Added: 1 predicate(s), 1 fact(s)"
    assert said[3:5] == ["  1: X='x' | b=1, d=0, status=true", "  2: X='y' | b=1, d=0, status=true"]
    assert said[5].startswith("  Merge error: Duplicate") and said[6].startswith("  Parse error: 'pred' needs")
    assert said[7] == "  1: b=0, d=0, status=neither" and said[8] == "  No results."
    assert said[9] == "  Unloaded predicate item/1: 1 declaration(s), 2 fact(s), 0 rule(s) removed." and said[-1] == "  Goodbye."


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"{tmp_path}/log")


def test_log_time_travel(spark, log):
    assert log.watermark() == 0
    mark = log.record(KnowledgeBase.parse('p(a) @{et:"2026-01-01T00:00:00Z"}. p(b) @{b:0.5, et:"2026-01-01T00:00:00Z"}. q(X) :- p(X).'))
    ids = {r.event_id for r in log.events().collect()}
    assert ids == {1, 2, 3} and mark == 3
    gone = log.facts("main").filter(F.col("b") == 0.5).first().event_id
    log.retract("main", gone)
    log.retract("main", 999)
    assert log.facts("main").count() == 1 and log.facts("main", mark).count() == 2
    assert [r.event_id for r in log.since(3).orderBy("event_id").collect()] == [4, 5]
    assert [r.branch for r in log.branches().collect()] == ["main"]
    kb = log.replay("main")
    assert len(kb.facts) == 1 and len(kb.rules) == 1
    assert log.record(kb) == 5  # nothing new


@pytest.mark.parametrize("kind", ["log", "memory"])
def test_repository(log, kind):
    repo = Repository(log) if kind == "log" else MemoryRepository()
    assert repo.get("main") is None
    with pytest.raises(KeyError):
        repo.require("main")
    kb = KnowledgeBase.parse('p(a) @{et:"2026-01-01T00:00:00Z"}. p(b) @{et:"2026-01-01T00:00:00Z"}.')
    repo.save(kb)
    kb.facts.pop()
    repo.save(kb)
    assert repo.require("main").facts == kb.facts and repo.list_names() == ["main"]
    repo.delete("main")
    assert repo.list_names() == []


def test_materialization_goes_stale(spark, log, tmp_path):
    log.record(KnowledgeBase.parse('p(a) @{et:"2026-01-01T00:00:00Z"}.'))
    made = Materialization(log, f"{tmp_path}/made")
    made.build("main", "?- p(X).")
    assert [r.X for r in made.read("main").collect()] == ["a"] and not made.stale("main")
    log.record(KnowledgeBase.parse('p(b) @{et:"2026-01-01T00:00:00Z"}.'))
    assert made.stale("main")


def test_stream(spark, log, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in")
    ingest(stream(), log, f"{tmp_path}/cp", "main", "named", ["id", "name"], once=True).awaitTermination()
    ingest(stream(), log, f"{tmp_path}/cp", "main", "named", ["id", "name"], once=True).awaitTermination()
    kb = log.bind(KnowledgeBase(), "main", ("named", 2))
    rows = Engine(spark).evaluate(kb, "?- named(I, N).").rows()
    assert sorted((r[0]["I"], r[0]["N"]) for r in rows) == [("1", "x"), ("2", "y")]


def test_bound_table_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    kb = KnowledgeBase().bind("t", spark.read.parquet(f"{tmp_path}/t"), ["id", "k"], distinct=True)
    plan = Engine(spark).evaluate(kb, "?- t(X, 2).").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,2)" in plan and "s:string" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("kind", ["log", "memory"])
def test_parts_of_a_branch(log, kind):
    with Repository(log) if kind == "log" else MemoryRepository() as repo:
        with pytest.raises(KeyError):
            repo.get_rules("main")
        kb = KnowledgeBase.parse('pred wind/1. wind(west) @{et:"2022-05-04T00:00:00Z"}. tide(low) @{et:"2022-05-04T00:00:00Z"}.')
        repo.save(kb)
        more = KnowledgeBase.parse('tide(high) @{b:0.5, et:"2022-05-04T00:00:00Z"}. sail(X) :- wind(X) @{et:"2022-05-04T00:00:00Z"}. !:- wind(X), tide(X) @{et:"2022-05-04T00:00:00Z"}.')
        repo.add_belief_record("main", more.facts[0])
        repo.add_rule("main", more.rules[0])
        repo.add_constraint("main", more.constraints[0])
        assert repo.get_belief_records("main", pred_name="tide") == [kb.facts[1], more.facts[0]] and len(repo.get_belief_records("main")) == 3
        assert repo.get_rules("main") == more.rules == repo.get_rules("main", head_pred_name="sail") and repo.get_rules("main", head_pred_name="wind") == []
        assert repo.get_constraints("main") == more.constraints
        assert {"wind", "tide"} <= {p.name for p in repo.get_predicates("main")}
        with pytest.raises(KeyError):
            repo.add_rule("nowhere", more.rules[0])


def test_typed_arguments(spark, log):
    from credence.streaming.ingest import as_assertions

    rows = [(1, 2.5, "a \"b\"", "2020-02-29", "2020-02-29 12:30:15.25"), (2, 9.0, "c", "2021-01-01", "1969-12-31 23:59:59.5"), (None, 1.0, "x", None, None)]
    df = spark.createDataFrame(rows, "n long, x double, s string, d string, t string").selectExpr("n", "x", "s", "cast(d as date) d", "cast(t as timestamp) z", "cast(t as timestamp_ntz) t", "INTERVAL '1 02:03:04.5' DAY TO SECOND * n as u")
    log.append(as_assertions(df, "main", "row", ["n", "x", "s", "d", "z", "t", "u"]))
    log.append(as_assertions(df.selectExpr("n as v"), "main", "mixed", ["v"]))
    log.append(as_assertions(df.selectExpr("s as v"), "main", "mixed", ["v"]))
    kb = log.attach("main")
    ask = lambda q: Engine(spark).evaluate(kb, q).rows()
    assert len(ask("?- row(N, X, S, D, Z, T, U).")) == 2  # a null argument is no fact
    assert [r[0]["N"] for r in ask('?- row(N, X, _, _, _, _, _), gt(X, 5).')] == [2]
    assert [r[0]["N"] for r in ask('?- row(N, _, "a \\"b\\"", d"2020-02-29", dt"2020-02-29T12:30:15.250000Z", dt"2020-02-29T12:30:15.250000", dur"P1DT2H3M4.5S").')] == [1]
    assert [r[0]["N"] for r in ask('?- row(N, _, _, _, Z, _, U), lt(Z, dt"1970-01-01T00:00:00Z"), eq(U, dur"P2DT4H6M9S").')] == [2]
    assert sorted((r[0]["V"] for r in ask("?- mixed(V).")), key=str) == [1, 2, 'a "b"', "c", "x"]
    same = log.replay("main")  # facts of program text are the same
    assert [r[0]["N"] for r in Engine(spark).evaluate(same, '?- row(N, _, _, _, Z, _, dur"P2DT4H6M9S").').rows()] == [2]


def test_times_do_not_depend_on_the_sessions_zone(spark, tmp_path):
    from credence.streaming.ingest import as_assertions

    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    log = EventLog(other, f"{tmp_path}/zoned")
    df = other.createDataFrame([(1, "2023-11-14 22:13:20")], "n long, t string").selectExpr("n", "cast(t as timestamp_ntz) t")
    log.append(as_assertions(df, "main", "at", ["n", "t"], et="t"))
    assert '"et":"2023-11-14T22:13:20.000000Z"' in log.events().first().payload
    for kb in (log.replay("main"), log.attach("main")):
        for known, n in (("22:13:19", 0), ("22:13:21", 1)):
            assert len(Engine(other).evaluate(kb, f'?- at(N, dt"2023-11-14T22:13:20") @{{known_at:"2023-11-14T{known}Z"}}').rows()) == n


def test_contributions(spark, tmp_path):
    from credence.functions.semantics import Semantics
    from credence.sources.contributions import Contributions

    rows = lambda *r: spark.createDataFrame(r, "x long, y string, e string, w double, v double")
    store = Contributions(spark, f"{tmp_path}/c")
    assert store.version() == 0 and store.states(("link", 2)).count() == 0
    first = store.upsert(rows((1, "a", "p", 0.5, 0.0), (1, "a", "q", 0.2, 0.1), (2, "b", "p", 0.3, 0.0), (None, "z", "p", 1.0, 0.0)), "link", ["x", "y"], "e", b="w", d="v")
    store.upsert(rows((1, "a", "p", 0.4, 0.5)), "link", ["x", "y"], "e", b="w", d="v")  # replaces 0.5
    last = store.retract(rows((1, "a", "q", 0.0, 0.0), (2, "b", "no such", 0.0, 0.0)), "link", ["x", "y"], "e")

    def states(version=None, how="noisy_or"):
        got = store.states(("link", 2), version, Semantics(support_aggregation=how)).collect()
        return {(int(r.a0.num), r.a1.txt): (round(r.b, 9), round(r.d, 9)) for r in got}

    assert states(first) == {(1, "a"): (0.6, 0.1), (2, "b"): (0.3, 0.0)}
    assert states(2) == {(1, "a"): (0.52, 0.55), (2, "b"): (0.3, 0.0)}
    assert states() == states(last) == {(1, "a"): (0.4, 0.5), (2, "b"): (0.3, 0.0)}
    # largest weights are never taken back
    assert states(how="maximum") == {(1, "a"): (0.5, 0.5), (2, "b"): (0.3, 0.0)}
    kb = store.bind(KnowledgeBase.parse("far(X) :- link(X, a)."), ("link", 2))
    assert [(r[0]["X"], round(r[1], 9)) for r in Engine(spark).evaluate(kb, "?- far(X).").rows()] == [(1, 0.2)]


def test_log_in_a_database(spark):
    import uuid

    from credence.sources.log import JdbcLog

    log = JdbcLog(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, partitions=2)
    repo = Repository(log)
    assert log.watermark() == 0 and repo.list_names() == []
    kb = KnowledgeBase.parse('wind(west) @{et:"2022-05-04T00:00:00Z"}. tide(7) @{b:0.5, et:"2022-05-04T00:00:00Z"}. sail(X) :- wind(X) @{et:"2022-05-04T00:00:00Z"}.')
    repo.save(kb)
    assert same(repo.require("main"), kb) and log.watermark() == 3
    kb.facts.pop()
    repo.save(kb)
    assert repo.get_belief_records("main") == kb.facts and log.facts("main", 3).count() == 2
    repo.delete("main")
    assert repo.get("main") is None


_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from credence.sources import log as logs
from credence.sources.kb import KnowledgeBase
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from credence.streaming.ingest import as_assertions
logs.ROWS_AT_ONCE = 7
log = logs.JdbcLog(spark, "jdbc:derby:memory:far;create=true", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
log.append(as_assertions(spark.range(50).selectExpr("id as k", "if(id % 2 = 0, 'even', null) as v"), "main", "t", ["k"], et=None))
before = log.events()
log.retract("main", 3)
log.record(KnowledgeBase.parse("u(X) :- t(X)."))
rows = log.events().collect()
assert before.count() == 50 and log.watermark() == 52 and sorted(r.event_id for r in rows) == list(range(1, 53)), rows
assert log.facts("main").count() == 49 and {r.src for r in rows} == {None} and len(log.attach("main").rules) == 1
print("all there")
"""


def test_embedded_database_of_a_cluster(tmp_path):
    """Executors can't see a database that lives in the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": root, "SPARK_HOME": pyspark.__path__[0], "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    home = tmp_path / "home"  # executors put their logs there
    home.mkdir()
    for p in Path(pyspark.__path__[0]).iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-c", _CLUSTER, str(tmp_path / "shared")], env=env | {"SPARK_HOME": str(home)}, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "all there" in done.stdout, done.stderr[-2000:]


def test_sorted_tables_skip_files(spark, tmp_path):
    from credence.sources.kb import store_sorted

    df = spark.range(4000).selectExpr("(id * 37) % 4000 as k", "id as v").repartition(6)
    made = store_sorted(df, f"{tmp_path}/sorted", ["k"], files=8)
    kb = KnowledgeBase().bind("t", made, ["k", "v"], distinct=True)
    assert len(Engine(spark).evaluate(kb, "?- t(1234, V).").rows()) == 1
    ranges = made.groupBy(F.input_file_name()).agg(F.min("k"), F.max("k")).collect()
    assert len(ranges) == 8 and sum(lo <= 1234 <= hi for _, lo, hi in ranges) == 1


def test_tools(tmp_path, capsys, monkeypatch, spark):
    import io
    import json

    from credence.cli import main

    one, two, out = (tmp_path / x for x in ("one.txt", "two.txt", "out.json"))
    one.write_text('pred wind/1 @{description:"where it blows from"}. wind(west) @{et:"2022-05-04T00:00:00Z"}.')
    two.write_text('sail(X) :- wind(X) @{et:"2022-05-04T00:00:00Z"}.')
    assert main(["merge", str(out), str(one), str(two)]) == 0
    merged = json.loads(out.read_text())
    assert same(KnowledgeBase.from_json(out.read_text()), KnowledgeBase.load(str(one)).merge(KnowledgeBase.load(str(two))))
    main(["schema"])
    made = json.loads(capsys.readouterr().out)
    kinds = {x["properties"]["kind"]["const"]: x for x in made["properties"]["statements"]["items"]["anyOf"]}
    assert kinds.keys() == {"predicate", "fact", "rule", "constraint"}
    for row in merged["statements"]:  # what is written has what the schema needs, and nothing that it doesn't name
        assert set(kinds[row["kind"]]["required"]) <= row.keys() <= kinds[row["kind"]]["properties"].keys()
    main(["extract-prompt", "The wind came from the west.", "--file", str(one), "--json"])
    text = capsys.readouterr().out
    assert "The wind came from the west." in text and "pred wind/1" in text and '"statements"' in text
    main(["query-prompt", "Who may sail?", "--file", str(two)])
    text = capsys.readouterr().out
    assert "Who may sail?" in text and "sail(X) :- wind(X)" in text and "between/3" in text
    # a session in a log, and one that keeps nothing
    for flags, n in (([], 1), (["--tmp"], 1)):
        monkeypatch.setattr("sys.stdin", io.StringIO("wind(east).\n?- wind(X).\n/- quit\n" if not flags else "wind(south).\n/- quit\n"))
        assert main(["--log", str(tmp_path / "log"), "--memory", "log", *flags]) == 0
        assert len(EventLog(spark, str(tmp_path / "log")).replay("main").facts) == n
    with pytest.raises(SystemExit):
        main(["--memory", "log"])
