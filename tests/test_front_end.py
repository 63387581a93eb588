"""Registry, tokens, dates, suggestions and the engine's methods."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillsift import Engine, EngineConfig, FilterSpec
from quillsift.catalog import Catalog, DataType
from quillsift.functions import dates, text
from quillsift.i18n import DictProvider, provider_for
from quillsift.operators import registry
from quillsift.plans import telemetry
from quillsift.plans.suggest import explain_score
from quillsift.sources.tables import sample_tasks, write_events

NOW = dt.datetime(2024, 1, 15, 12)
D = dt.datetime


# registry


def test_registry():
    assert [len(registry.operators_for(t)) for t in DataType] == [12, 11, 6, 11, 6, 4]
    assert len(registry.categories()) == 7 and sum(len(registry.operators_in(c)) for c in registry.categories()) == 21
    assert registry.is_alias("at", "eq", DataType.DATE) and not registry.is_alias("at", "eq", DataType.STRING)
    assert registry.default_operator(DataType.STRING) == "contains" and registry.default_operator(DataType.BOOLEAN) == "isTrue"
    assert registry.is_valid_for("between", DataType.DATE) and not registry.is_valid_for("in", DataType.DATE)
    assert registry.is_operator("nin") and not registry.is_operator("xx")
    assert registry.search_terms("eq")[:2] == ["eq", "equals"]


@pytest.mark.parametrize(("operator", "n"), [("lt", 8), ("lte", 48), ("gt", 12), ("gte", 72), ("neq", 6), ("startsWith", 4), ("endsWith", 2), ("isEmpty", 8), ("isNotEmpty", 8)])
def test_alias_expansion(operator, n):
    assert len(registry.expand_patterns(registry.OPERATORS[operator].patterns)) == n


def test_spread_keywords():
    assert registry.spread_pairs() == [("from", "to"), ("from", "till"), ("from", "until"), ("between", "and")]
    assert registry.spread_starts() == {"from", "between"} and registry.spread_separators() == {"to", "till", "until", "and"}


# text


def test_tokenize():
    t = text.tokenize
    assert t("status in open").texts == ["status", "in", "open"]
    assert t("a>=5 b!= c").texts == ["a", ">=", "5", "b!", "=", "c"]
    assert t("name = 'two words' \"x\\\"y\"").texts == ["name", "=", "two words", 'x"y']
    assert t("say 'open end").texts == ["say", "open end"]
    assert not t("a").complete and t("a ").complete and not t("").complete
    assert [(x.begin, x.end) for x in t("ab  cd").tokens] == [(0, 2), (4, 6)]


def test_ngrams():
    grams = text.ngrams(text.tokenize("a b c d e").tokens)
    assert [g.text for g in grams[:6]] == ["a", "b", "c", "d", "e", "a b"] and len(grams) == 5 + 4 + 3 + 2
    assert (grams[-1].text, grams[-1].begin, grams[-1].end) == ("b c d e", 2, 9)


def test_match_and_score():
    assert text.match("prio", "Priority") == [0, 1, 2, 3]
    assert text.match("ip", "In Progress") == [0, 3]
    assert text.match("zz", "Priority") is None
    assert text.smart_score(text.match("open", "Open"), "Open") == 1.0
    assert text.smart_score([3, 4], "In Progress") == pytest.approx(0.95 * (0.8 + 0.2 * 2 / 11))
    assert text.smart_score([], "x") == 0
    assert text.shorten("short") is None
    cut, moved = text.shorten("x" * 40 + "match" + "y" * 40, list(range(40, 45)))
    assert cut[moved[0] : moved[-1] + 1] == "match" and len(cut) <= 32


def test_text_columns(spark):
    values = ["status in open", "a>=5 'two words' b", "one two three four five", ""]
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.tokens_column(F.col("t")).alias("k"))
    for r in df.select("t", "k", text.ngrams_column(F.col("k")).alias("g")).collect():
        tokens = text.tokenize(r["t"])
        assert [x.strip("'") for x in r["k"]] == tokens.texts
        assert [x.replace("'", "") for x in r["g"]] == [g.text for g in text.ngrams(tokens.tokens)]


# dates


@pytest.mark.parametrize(
    ("phrase", "start", "end"),
    [
        ("2024-01-04", D(2024, 1, 4), None), ("2024-01-04T10:30:00Z", D(2024, 1, 4, 10, 30), None), ("1/4/2024", D(2024, 1, 4), None), ("Jan 4, 2026", D(2026, 1, 4), None), ("4th of March 2023", D(2023, 3, 4), None),
        ("yesterday", D(2024, 1, 14, 12), None), ("tomorrow", D(2024, 1, 16, 12), None), ("3 days ago", D(2024, 1, 12, 12), None), ("in two weeks", D(2024, 1, 29, 12), None), ("next month", D(2024, 2, 15, 12), None),
        ("last week", D(2024, 1, 8), D(2024, 1, 15, 23, 59, 59, 999000)), ("this week", D(2024, 1, 14), D(2024, 1, 15, 23, 59, 59, 999000)), ("last month", D(2023, 12, 16), D(2024, 1, 15, 23, 59, 59, 999000)),
        ("this month", D(2024, 1, 1), D(2024, 1, 15, 23, 59, 59, 999000)), ("this year", D(2024, 1, 1), D(2024, 1, 15, 23, 59, 59, 999000)), ("last year", D(2023, 1, 15), D(2024, 1, 15, 23, 59, 59, 999000)),
        ("yesterday today", D(2024, 1, 14, 12), D(2024, 1, 15, 12)), ("today to yesterday", D(2024, 1, 14, 12), D(2024, 1, 15, 12)),
    ],
)
def test_dates(phrase, start, end):
    got = dates.parse_date(phrase, NOW)
    assert (got.start, got.end) == (start, end)


def test_date_helpers():
    assert dates.parse_date("no such thing", NOW) is None and dates.parse_date("", NOW) is None
    assert dates.parse_date("2024-13-45", NOW) is None
    assert dates.parse_date("heute", NOW, "de").start == NOW and dates.parse_date("letzte Woche", NOW, "de-AT").is_range
    assert dates.parse_date("heute", NOW, "en") is None
    assert [x.text for x in dates.detect_dates("due yesterday or on 2024-01-04", NOW)] == ["yesterday", "2024-01-04"]
    assert dates.format_date(D(2026, 1, 4)) == "Jan 4, 2026"
    assert dates.might_be_date("last week") and dates.might_be_date("x 1/2/2024") and not dates.might_be_date("open") and not dates.might_be_date(" ")
    assert len(dates.date_suggestions("fr")) == 8 and dates.date_suggestions("xx") == dates.date_suggestions("en")


# engine

TASKS = [dict(id="status", type="enum", name="Status"), dict(id="priority", type="number", name="Priority"), dict(id="assignee", type="string", name="Assignee", aliases=["owner"]), dict(id="due", type="date", name="Due Date", aliases=["deadline"]), dict(id="isBlocked", type="boolean", name="Blocked")]
ROWS = [("Open", 1, "Ada", D(2024, 1, 14, 9), False, 1), ("Closed", 2, "Alan", D(2024, 1, 15, 8), True, 2), ("In Progress", 3, "Ada", D(2024, 1, 10), False, 3), ("Open", 4, "Grace", D(2024, 1, 1), True, 4), ("In Progress", 5, "Linus", None, True, 5), ("In Progress", 1, "Ada", D(2023, 1, 1), False, 6)]
TASK_SCHEMA = "status string, priority int, assignee string, due timestamp_ntz, isBlocked boolean, id int"


@pytest.fixture
def engine(spark):
    e = Engine(spark, EngineConfig(now=NOW, telemetry=True))
    e.set_schema(TASKS)
    e.index_data(spark.createDataFrame(ROWS, TASK_SCHEMA), ["id"])
    yield e
    e.destroy()


def test_execute_and_context(engine):
    f = FilterSpec.of
    assert engine.count(f("status", "in", ["Open"])) == 2 and engine.count(f("status", "in", ["Open", "In Progress"])) == 5
    assert engine.count(f("status", "in", ["Open"])) + engine.count(f("status", "nin", ["Open"])) == 6
    assert engine.count(f("assignee", "eq", "Ada"), [f("status", "eq", "In Progress")]) == 2
    assert engine.count(f("priority", "gt", 2), [f("status", "eq", "In Progress"), f("assignee", "eq", "Ada")]) == 1
    assert engine.execute(f("due", "eq", "yesterday")).count() == 1
    assert engine.compile_filter("nothing", "eq", 1) is None
    assert [o.id for o in engine.get_operators_for_column("isBlocked")] == ["eq", "neq", "isEmpty", "isNotEmpty", "isTrue", "isFalse"]
    assert engine.get_operators_for_column("nothing") == []


def top(engine, query, n=1, **more):
    return [s.id for s in engine.suggest(query, **more).suggestions[:n]]


def test_suggestions(engine):
    assert [s.split(":")[:2] for s in top(engine, "", 5)] == [[c["id"], "eq"] for c in TASKS]
    for q in ("status notin", "nin status"):
        p = engine.parse(q)
        assert (p.column, p.operator) == ("status", "nin")
    assert top(engine, "status in open closed") == ["status:in:Open,Closed"]
    assert top(engine, "status not equal open") == ["status:neq:Open"]
    assert top(engine, "in progress") == ["status:eq:In Progress"]
    ids = top(engine, "prio 3 4", 10)
    assert ids[0] == "priority:between:3,4" and ids.index("priority:between:3,4") < ids.index("priority:eq:3")
    first = engine.suggest("prio 3").suggestions[0]
    assert (first.id, first.result_count) == ("priority:eq:3", 1)
    assert not engine.suggest("between 3").suggestions[0].is_complete
    assert "priority:between:3,5" in top(engine, "between 3 5", 3)
    assert top(engine, "blocked true") == ["isBlocked:isTrue:"]
    assert "between" in top(engine, "yesterday today")[0] and "between" in top(engine, "deadline last week")[0]
    for q in ("from 2 to 4", "from 2 till 4", "from 4 until 2", "between 2 and 4"):
        assert top(engine, q) == ["priority:between:2,4"]
    assert all(s.startswith("due:") for s in top(engine, "at 2024-01-15", 3))
    assert top(engine, "owner ada")[0].startswith("assignee:eq:Ada")


def test_suggestion_limits(engine):
    for q in ("status open", "open closed progress", "prio 1 2 3", "status in open"):
        out = engine.suggest(q)
        n = len(text.tokenize(q).tokens)
        assert len(out.suggestions) <= 10 and all(len(s.args) <= n for s in out.suggestions)
        assert len({s.id for s in out.suggestions}) == len(out.suggestions)
        assert [s.score for s in out.suggestions] == sorted((s.score for s in out.suggestions), reverse=True)
        assert sum(out.categories().values()) == len(out.suggestions)


def test_counts_are_those_of_execution(engine):
    context = [FilterSpec.of("isBlocked", "isFalse")]
    for q in ("open", "prio 1", "due before 2024-01-12", "ada", "status not equal open"):
        for s in engine.suggest(q, context=context).suggestions:
            if s.is_complete:
                assert s.result_count == engine.execute(s.spec, context).count(), s.id


def test_values_of_the_context_only(engine):
    context = [FilterSpec.of("status", "eq", "Open")]
    assert not any("Closed" in s for s in top(engine, "closed", 10, context=context))
    assert "priority:eq:3" not in top(engine, "prio 3", 10, context=context) and "priority:eq:1" in top(engine, "prio 1", 10, context=context)


def test_compile_and_validate(engine):
    assert engine.compile("status eq Open") == FilterSpec("status", "eq", ("Open",))
    assert engine.compile("priority gt 2.5") == FilterSpec("priority", "gt", (2.5,))
    assert engine.compile("priority between 2 4") == FilterSpec("priority", "between", (2, 4))
    assert engine.execute(engine.compile("status in open closed")).count() == 3
    assert engine.validate("xyzzy")[1] == ["No column specified", "No operator specified"]
    assert engine.validate("status equals")[1] == ["Operator 'equals' requires a value"]
    assert engine.compile("xyzzy") is None


def test_changes(engine, spark):
    engine.add_row(spark.createDataFrame([("New", 9, "Zoe", None, None, 7)], TASK_SCHEMA))
    assert top(engine, "zoe")[0] == "assignee:eq:Zoe" and engine.get_data().count() == 7
    engine.update_rows(spark.createDataFrame([("Newer", 9, "Zoe", None, None, 7), ("More", 1, "Yan", None, None, 8)], TASK_SCHEMA))
    assert engine.get_data().where("id = 7").first()["status"] == "Newer" and engine.get_data().count() == 8
    engine.remove_row(7)
    assert top(engine, "zoe") == [] and engine.get_data().count() == 7
    engine.remove_row(99)
    engine.remove_rows(F.col("priority") == 1)
    assert engine.get_data().count() == 4
    with pytest.raises(TypeError):
        engine.remove_rows(lambda row: True)
    stats = engine.get_index_stats().first()
    assert stats["total_rows"] == 4 and stats["columns_indexed"] == 5
    engine.clear_index()
    with pytest.raises(RuntimeError):
        engine.get_data()


def test_many_values(spark):
    e = Engine(spark, EngineConfig(now=NOW))
    e.set_schema([dict(id="name", type="string")])
    e.index_data_async(spark.range(200).select(F.concat(F.lit("Name"), "id").alias("name")))
    assert e.get_index_stats().first()["unique_values"] == 200
    assert top(e, "name150") == ["name:eq:Name150"]


def test_context_indexes_are_bounded(spark):
    e = Engine(spark, EngineConfig(now=NOW, contexts=2))
    e.set_schema([dict(id="id", type="number")])
    e.index_data(spark.range(5))
    for i in range(4):
        e.value_index([FilterSpec("id", "gt", (i,))])
    assert len(e._indexes) == 2


def test_sort_and_row_ids(engine):
    data = engine.dataset
    assert [r["isBlocked"] for r in data.sort("isBlocked").collect()] == [True] * 3 + [False] * 3
    assert [r["due"] for r in data.sort("due", True).collect()][-1] is None and [r["due"] for r in data.sort("due").collect()][-1] is None
    assert [(r["id"], r["_row_id"]) for r in data.with_row_id("id").orderBy("id").collect()] == [(i + 1, i) for i in range(6)]


def test_row_ids_follow_a_sort(engine):
    """Places in a stated order, nulls last either way."""
    data = engine.dataset
    for descending in (False, True):
        want = [r["id"] for r in data.sort("due", descending).collect()]
        assert [r["id"] for r in data.with_row_id(*data.order("due", descending)).orderBy("_row_id").collect()] == want


def test_quarters():
    now = D(2024, 5, 31, 12)
    at = lambda t: dates.parse_date(t, now)
    assert (at("last quarter").start, at("next quarter").start, at("this quarter").start) == (D(2024, 2, 29, 12), D(2024, 8, 31, 12), D(2024, 4, 1))
    assert not any(at(f"{w} quarter").is_range for w in ("last", "this", "next"))
    assert at("2 quarters ago").start == D(2023, 11, 30, 12) and at("in 1 quarter").start == D(2024, 8, 31, 12)
    assert at("within the last 3 days").start == at("past 3 days").start == D(2024, 5, 28, 12)


@pytest.mark.parametrize(
    "locale, text, expected",
    [
        ("de", "31.12.2024", D(2024, 12, 31)),
        ("de-AT", "3. März 2023", D(2023, 3, 3)),
        ("de", "Mai 2022", D(2022, 5, 1)),
        ("de", "vor 2 Wochen", D(2024, 1, 1, 12)),
        ("de", "in 1 Quartal", D(2024, 4, 15, 12)),
        ("fr", "31/12/2024", D(2024, 12, 31)),
        ("fr", "1er août 2023", D(2023, 8, 1)),
        ("fr", "il y a 3 jours", D(2024, 1, 12, 12)),
        ("es", "5 de marzo de 2021", D(2021, 3, 5)),
        ("es", "hace 1 año", D(2023, 1, 15, 12)),
        ("es", "dentro de 2 meses", D(2024, 3, 15, 12)),
        ("nl", "04-07-2023", D(2023, 7, 4)),
        ("nl", "3 dagen geleden", D(2024, 1, 12, 12)),
        ("nl", "12 mei", D(2024, 5, 12)),
        ("pt", "25 de dezembro de 2020", D(2020, 12, 25)),
        ("pt", "há 2 semanas", D(2024, 1, 1, 12)),
        ("ja", "2024年12月31日", D(2024, 12, 31)),
        ("ja", "3日前", D(2024, 1, 12, 12)),
        ("en", "03/04/2024", D(2024, 3, 4)),
        ("de", "2024-03-04", D(2024, 3, 4)),
        ("de", "tomorrow", D(2024, 1, 16, 12)),
    ],
)
def test_local_dates(locale, text, expected):
    assert dates.parse_date(text, D(2024, 1, 15, 12), locale).start == expected


def test_local_dates_that_are_none():
    for locale, text in (("de", "31.13.2024"), ("fr", "il y a"), ("en", "31.12.2024"), ("ja", "年月日")):
        assert dates.parse_date(text, D(2024, 1, 15, 12), locale) is None


def test_strategies(spark):
    """What each strategy makes by itself, and one of a caller's own."""
    from quillsift.plans import strategies

    rows = [("Open", 1, D(2024, 1, 1)), ("Open", 2, D(2024, 1, 5)), ("Closed", 3, None)]
    columns = [dict(id="status", type="enum", name="Status"), dict(id="priority", type="number", name="Priority"), dict(id="due", type="date", name="Due")]

    def made(text, *names, **config):
        e = Engine(spark, EngineConfig(now=NOW, persist=False, **({"strategies": tuple(s for s in strategies.STRATEGIES if s.name in names)} if names else {}), **config))
        e.set_schema(columns)
        e.index_data(spark.createDataFrame(rows, "status string, priority int, due timestamp_ntz"))
        return [(s.id, round(s.score, 4)) for s in e.suggest(text).suggestions]

    assert made("", "empty") == [("status:eq:", 0.0), ("priority:eq:", 0.0), ("due:eq:", 0.0)]
    assert made("from 5 to 2", "spread") == [("priority:between:2,5", 0.95)]
    assert made("status", "column") == [("status:eq:", 0.4), ("status:neq:", 0.4), ("status:in:", 0.4)]
    assert made("open", "value") == [("status:eq:Open", 0.4)]
    assert made("gte", "operator") == [("priority:gte:", 0.2), ("due:gte:", 0.2)]
    assert made("gte 2", "operator") == [("priority:gte:2", 0.6), ("priority:gte:", 0.1), ("due:gte:", 0.1)]
    assert made("status neq", "column and operator") == [("status:neq:", 0.6), ("status:neq:Open", 0.54), ("status:neq:Closed", 0.54)]
    assert made("7", "numbers") == [(f"priority:{o}:7", 0.5) for o in ("eq", "neq", "lt", "lte", "gt")]
    numbers = dict(made("7 5 9", "numbers"))
    assert numbers["priority:between:5,7"] == 0.45 and numbers["priority:in:7,5,9"] == 0.5 and numbers["priority:eq:7"] == 0.4
    assert [i.split(":")[1] for i, _ in made("2024-01-05", "dates")] == ["eq", "neq", "lt", "lte", "gt"]
    assert [i.split(":")[1] for i, _ in made("last week", "dates")][:1] == ["between"]
    assert made("open closed", "values") == [("status:in:Open,Closed", 0.4), ("status:nin:Open,Closed", 0.4)]
    assert made("status open closed", "column and values") == [("status:in:Open,Closed", 0.8), ("status:nin:Open,Closed", 0.8)]
    assert made("nin open closed", "operator and values") == [("status:nin:Open,Closed", 0.6)]
    for silent in ("numbers", "dates", "values"):
        assert made("status 7", silent) == []

    class Highest:
        name = "highest"

        def handles(self, query):
            return query.found.tokens.texts == ["highest"]

        def generate(self, query):
            yield query.make(query.catalog.get("priority"), "gte", (3,), 1.0)

    assert made("highest", strategies=(*strategies.STRATEGIES, Highest()))[0] == ("priority:gte:3", 1.0)
    assert [strategies.Literal.of(v).kind for v in ("x", 1, 2.5, True, dates.parse_date("today", NOW))] == ["string", "number", "number", "boolean", "date"]


def test_explain_score():
    from quillsift.plans.parse import Match

    gram = lambda i, j: text.Ngram("x", i, j, 0, 0)
    c, o, v = (Match(k, "k", "t", gram(i, i), 1.0) for i, k in enumerate(("column", "operator", "value")))
    assert explain_score(3, c, o, [v]) == pytest.approx(1.0)
    assert explain_score(5, c, o, [v]) == pytest.approx(0.6)
    assert explain_score(3, c, Match("operator", "k", "t", gram(0, 0), 1.0), []) == pytest.approx(0.4 / 3)


def test_i18n(spark):
    german = provider_for("de-DE")
    assert german.operator_label("contains") == "enthält" and german.word_sets()["to"] == ("bis",)
    assert provider_for("xx").operator_label("eq") == "equals"
    assert DictProvider("fr", labels={"eq": "vaut"}).operator_label("neq") == "not equals"
    heard = []
    stop = german.on_change(lambda: heard.append(1))
    german.switch(provider_for("fr"))
    stop()
    german.switch(provider_for("es"))
    assert heard == [1] and german.locale() == "es"
    e = Engine(spark, EngineConfig(now=NOW, provider=DictProvider("x", texts={"k.open": "Offen", "k.status": "Zustand"}), locale="de"))
    e.set_schema([dict(id="status", type="enum", key="k.status", values=[dict(value="open", key="k.open"), dict(value="closed", label="Shut")])])
    e.index_data(spark.createDataFrame([("open",), ("closed",)], "status string"))
    first = e.suggest("zustand offen").suggestions[0]
    assert (first.column_id, first.args, first.result_count) == ("status", ("open",), 1) and "Offen" in first.label
    assert top(e, "shut")[0] == "status:eq:closed"


def test_telemetry(engine, spark, tmp_path):
    heard = []
    engine.collector.on_event(heard.append)
    engine.suggest("open")
    assert heard[0]["operation"] == "suggest" and heard[0]["outcome"] == "success" and heard[0]["fields"]["query"] == "open" and "total" in heard[0]["phases"]
    frame = engine.get_telemetry().frame(spark)
    assert frame.count() == len(engine.collector.events)
    c = telemetry.Collector(limit=3)
    for i in range(5):
        e = c.start_event("op", n=i)
        e.success()
        e.error("late")  # an event ends once
    assert [x["fields"]["n"] for x in c.events] == ["2", "3", "4"] and {x["outcome"] for x in c.events} == {"success"}
    assert len(c.by_operation("op")) == 3 and len(c.since(0)) == 3 and "op" in c.to_json()
    values = [(f"op{i % 2}", float(v), "error" if i % 4 == 0 else "success") for i, v in enumerate([5, 1, 4, 2, 3, 3, 9, 8, 7])]
    df = spark.createDataFrame(values, "operation string, duration double, outcome string")
    got = {r["operation"]: r for r in telemetry.percentiles(df).collect()}
    for op in ("op0", "op1"):
        own = sorted(v for o, v, _ in values if o == op)
        assert [got[op][p] for p in ("p50", "p95", "p99")] == [own[int(len(own) * p)] for p in (0.5, 0.95, 0.99)]
        assert (got[op]["count"], got[op]["min"], got[op]["max"]) == (len(own), own[0], own[-1])
    assert telemetry.error_rate(df, F.col("outcome") == "error").first()["error_rate"] == 33.33
    assert telemetry.error_rate(df.limit(0), F.col("outcome") == "error").first()["error_rate"] == 0
    write_events(df, str(tmp_path / "e"), "svc", "test")
    assert {(r["_service"], r["_environment"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {("svc", "test")}


def test_percentiles_by_slices(spark):
    """So many different durations that quantiles worked out twice differ; an operation that is null is one too."""
    operation = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")
    df = spark.range(200_000, numPartitions=8).select(operation.alias("operation"), (F.pmod(F.xxhash64("id"), F.lit(10**12)) / 1e6).alias("duration"))
    own = {}
    for op, v in df.collect():
        own.setdefault(op, []).append(v)
    got = {r["operation"]: r for r in telemetry.percentiles(df, slices=16, together=0).collect()}
    assert set(got) == {"a", "b", None}
    for op, values in own.items():
        values.sort()
        assert [got[op][p] for p in ("p50", "p95", "p99")] == [values[int(len(values) * p)] for p in (0.5, 0.95, 0.99)]
        assert (got[op]["count"], got[op]["min"], got[op]["max"]) == (len(values), values[0], values[-1])
        assert got[op]["mean"] == pytest.approx(sum(values) / len(values))


EVENTS_SCHEMA = "ts timestamp, op string, ms double"


def streamed(spark, frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_streaming_rollup(spark, tmp_path):
    """Files arrive one by one; events of a window that the watermark has closed are left out, the others are counted as in a batch."""
    from quillsift.streaming.incremental import event_rollup

    path = str(tmp_path / "in")
    parts = [[(D(2024, 1, 1, 0, m), "a", float(m)) for m in (0, 20, 40)], [(D(2024, 1, 1, 1, m), "a", 10.0) for m in (5, 50)] + [(D(2024, 1, 1, 1, 55), "b", 1.0)], [(D(2024, 1, 1, 5), "a", 7.0)], [(D(2024, 1, 1, 0, 30), "a", 999.0), (D(2024, 1, 1, 4, 55), "b", 3.0)], [(D(2024, 1, 1, 9), "a", 1.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01 * i)
    files = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = {(r["window_start"].hour, r["operation"]): (r["n"], r["mean_duration"], r["max_duration"]) for r in streamed(spark, event_rollup(files, "ts", "op", "ms"), "append", "rollup").collect()}
    assert got == {(0, "a"): (3, 20.0, 40.0), (1, "a"): (2, 10.0, 10.0), (1, "b"): (1, 1.0, 1.0), (4, "b"): (1, 3.0, 3.0), (5, "a"): (1, 7.0, 7.0)}
    everything = event_rollup(spark.read.parquet(path), "ts", "op", "ms")
    assert {(r["window_start"].hour, r["operation"]): r["n"] for r in everything.collect()}[0, "a"] == 4  # a batch leaves nothing out


def test_streaming_index(spark, tmp_path):
    """The running index after several batches is that of all rows, and merging the batches' indexes gives it too."""
    from quillsift.plans.index import value_index
    from quillsift.streaming.incremental import merge_index, streaming_value_index

    path = str(tmp_path / "in")
    halves = [spark.createDataFrame([(D(2024, 1, 1, h), f"op{h % k}", float(h)) for h in range(9)], EVENTS_SCHEMA).coalesce(1) for k in (2, 3)]
    for half in halves:
        half.write.mode("append").parquet(path)
    files = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    whole = {tuple(r) for r in value_index(spark.read.parquet(path), ["op", "ms"]).collect()}
    assert {tuple(r) for r in streamed(spark, streaming_value_index(files, ["op", "ms"]), "complete", "running").collect()} == whole
    assert {tuple(r) for r in merge_index(*(value_index(h, ["op", "ms"]) for h in halves)).collect()} == whole


def test_stream_of_events(spark, tmp_path):
    """Each event is written once, also when a batch is run again."""
    from quillsift.sources.tables import stream_events

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(D(2024, 1, 1, h), f"op{k}", float(h)) for h in range(5)], EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for checkpoint in ("first", "again") if k else ("first",):
            events = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            stream_events(events, out, str(tmp_path / checkpoint), "svc", "test", once=True).awaitTermination(120)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.distinct().count() == 10 and {r["_service"] for r in rows.collect()} == {"svc"}
    assert rows.groupBy("op").count().where("count = 5").count() == 2


def test_progress(spark):
    heard = []
    e = Engine(spark, EngineConfig(now=NOW))
    e.set_schema([dict(id="name", type="string"), dict(id="n", type="number")])
    e.index_data_async(spark.range(0, 4_000_000, 1, 64).select(F.concat(F.lit("Name"), F.col("id") % 1000).alias("name"), F.col("id").alias("n")), on_progress=heard.append)
    assert heard[0] == 0.0 and heard[-1] == 1.0 and heard == sorted(heard) and len(heard) > 2
    assert [k for _, k in e._indexes] == [("name",)]  # numbers aren't indexed for texts
    e.set_schema([dict(id="n", type="number")])
    assert top(e, "7") == ["n:eq:7"]


def test_row_sets(spark):
    from quillsift.plans.rowsets import RowSet

    rows = spark.createDataFrame([(i, i % 2, i % 3) for i in (*range(-70, 200), 5_000_000_000)] + [(None, 0, 0)], "_row_id long, two int, three int")
    a, b = RowSet.of(rows, F.col("two") == 0), RowSet.of(rows, F.col("three") == 0)
    ids = [*range(-70, 200), 5_000_000_000]
    x, y = {i for i, t in zip(ids, (r["two"] for r in rows.collect())) if t == 0}, {i for i, t in zip(ids, (r["three"] for r in rows.collect())) if t == 0}
    for got, want in ((a, x), (a.and_(b), x & y), (a.or_(b), x | y), (a.and_not(b), x - y), (a.xor(b), x ^ y), (a.and_not(a), set())):
        assert {r["_row_id"] for r in got.ids().collect()} == want and got.cardinality().first()[0] == len(want)


def test_sample_is_the_same_for_any_partitions(spark):
    a = sample_tasks(spark, 500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, sample_tasks(spark, 500).repartition(7).collect()))
    assert a.where("(status = 'Blocked') <> isBlocked").count() == 0 and 40 < a.where("isBlocked").count() < 110
    Catalog.infer(a.schema).check(a.schema)
