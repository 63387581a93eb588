"""From text to filters: tokens, candidates, compiled filters and ranked suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.text import ngrams_column, tokens_column
from quillsift.operators.predicates import FilterSpec
from quillsift.plans import index as plans
from quillsift.plans import parse
from quillsift.plans.queries.base import NOW, ORDERS, Query, dataset, query
from quillsift.plans.suggest import SCHEMA, Suggester, to_rows
from quillsift.sources.tables import table

#: Columns of orders whose values texts are matched with.
_MATCHED = ["o_orderstatus", "o_orderpriority"]


@query(r"""
SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '("[^"]*"|''[^'']*''|>=|<=|!=|==|<>|[<>=~]|[^\s"''<>=~]+)'), '|') AS tokens FROM part
""")
def tokenize_col(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.array_join(tokens_column(F.col("p_name")), "|").alias("tokens"))


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
g AS (
    SELECT p_partkey, w AS one,
        [array_to_string(w[i:i+1], ' ') for i in range(1, len(w))] AS two,
        [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)] AS three,
        [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] AS four
    FROM p
)
SELECT p_partkey, array_to_string(list_concat(list_concat(one, two), list_concat(three, four)), '|') AS ngrams FROM g
""")
def ngrams_col(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.array_join(ngrams_column(F.split("p_name", " ")), "|").alias("ngrams"))


@query("""
SELECT 'p_name' AS column_id, p_name AS value, count(*) AS row_count FROM part WHERE regexp_matches(lower(p_name), 's.*?m.*?l') GROUP BY 2
""")
def subsequence_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return parse.subsequence_candidates(plans.value_index(table(spark, folder, "part"), ["p_name"]), "sml")


@query("""
SELECT 'p_brand' AS column_id, p_brand AS value, count(*) AS row_count FROM part WHERE starts_with(lower(p_brand), 'brand#2') GROUP BY 2
""")
def prefix_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return parse.prefix_candidates(plans.value_index(table(spark, folder, "part"), ["p_brand"]), "brand#2")


_SEARCHED = ["re", "brand", "eco", "sml"]


def _candidates_sql(texts: list[str]) -> str:
    """The best ten values for each text: density squared, place and coverage of the first place, or of the leftmost stretch."""
    columns = ("p_name", "p_brand", "p_type")
    index = " UNION ALL ".join(f"SELECT '{c}' AS column_id, {c} AS value, count(*) AS row_count FROM part GROUP BY 2" for c in columns)
    each = []
    for i, q in enumerate(texts):
        stretch = f"regexp_extract(lower(value), '({'.*?'.join(q)})', 1)"
        each.append(f"SELECT {i} AS ngram, *, {len(q)} AS matched, CASE WHEN contains(lower(value), '{q}') THEN '{q}' ELSE {stretch} END AS stretch FROM i")
    return rf"""
WITH i AS ({index}),
m AS ({" UNION ALL ".join(each)}),
p AS (
    SELECT *, strpos(lower(value), stretch) - 1 AS first, matched::DOUBLE / length(stretch) AS density,
        0.8::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, matched::DOUBLE / length(value)) AS coverage
    FROM m WHERE stretch <> ''
),
b AS (
    SELECT *, CASE WHEN first = 0 THEN 1.0::DOUBLE
        WHEN regexp_matches(substr(value, first::BIGINT, 1), '[\s_\-./\\]') THEN 0.95::DOUBLE ELSE 0.6::DOUBLE END AS place FROM p
),
s AS (SELECT ngram, column_id, value, row_count, place * coverage * pow(density, 2) AS score FROM b)
SELECT column_id, value, row_count, ngram, round(score, 9) AS score FROM s WHERE score >= 0.1
QUALIFY row_number() OVER (PARTITION BY ngram ORDER BY score DESC, row_count DESC, column_id, value) <= 10
"""


@query(_candidates_sql(_SEARCHED))
def value_candidates(spark: SparkSession, folder: str) -> DataFrame:
    index = plans.value_index(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return parse.value_candidates(index, _SEARCHED).withColumn("score", F.round("score", 9))


def _parsed(spark: SparkSession, folder: str, text: str) -> parse.Parsed:
    index = plans.value_index(dataset(spark, folder, "orders").df, _MATCHED)
    return parse.assign(parse.find_matches(text, ORDERS, index, NOW), ORDERS)


def _compiled(text: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spec = _parsed(spark, folder, text).spec
        return dataset(spark, folder, "orders").execute(spec).select("o_orderkey", spec.column)

    return run


for _name, _text, _column, _condition in (
    ("compile_text", "priority in 1-URGENT 2-HIGH", "o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("compile_number", "price gt 250000.5", "o_totalprice", "o_totalprice > 250000.5"),
    ("compile_date_phrase", "ordered before 1995-03-15", "o_orderdate", "o_orderdate < TIMESTAMP '1995-03-15'"),
):
    query(f"SELECT o_orderkey, {_column} FROM orders WHERE {_condition}", _name)(_compiled(_text))


@query("""
SELECT * FROM (VALUES
    ('priority eq 1-URGENT', 'o_orderpriority', 'eq', '1-URGENT', ''),
    ('status in F O', 'o_orderstatus', 'in', 'F,O', ''),
    ('price between 1000 2000', 'o_totalprice', 'between', '1000,2000', ''),
    ('ordered before 1995-01-01', 'o_orderdate', 'lt', '1995-01-01T00:00:00', ''),
    ('price', 'o_totalprice', NULL, '', 'No operator specified')
) AS t(text, column_id, operator, args, errors)
""")
def parse_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for text in ("priority eq 1-URGENT", "status in F O", "price between 1000 2000", "ordered before 1995-01-01", "price"):
        p = _parsed(spark, folder, text)
        args = ",".join(a.start.isoformat() if hasattr(a, "start") else str(a) for a in p.args)
        rows.append((text, p.column, p.operator, args, "; ".join(p.errors)))
    return spark.createDataFrame(rows, "text string, column_id string, operator string, args string, errors string")


def _suggest(spark: SparkSession, folder: str, text: str, context: tuple[FilterSpec, ...] = ()) -> DataFrame:
    """Ranked suggestions, with arguments and matches as text."""
    data = dataset(spark, folder, "orders").context(context)
    response = Suggester(ORDERS, None, NOW).suggest(text, plans.value_index(data.df, _MATCHED), data.df, data.bind, 10, bool(context))
    argument = F.transform("arguments", lambda a: F.concat_ws(":", a["kind"], a["value"]))
    match = F.transform("query_matches", lambda m: F.concat_ws(":", m["type"], m["start"], m["end"], m["target"], F.round(m["score"], 6).cast("string")))
    rows = spark.createDataFrame(to_rows(response), SCHEMA)
    return rows.withColumns({"arguments": F.array_join(argument, ","), "query_matches": F.array_join(match, ","), "score": F.round("score", 6)})


def _suggested(rows: list[tuple], counts: str) -> str:
    """SQL for suggestions (label, column, operator, argument, its count's name in `counts`, score, category, matches) in order, worked out by hand."""
    out = []
    for rank, (label, column, operator, argument, count, score, category, matches) in enumerate(rows, 1):
        cells = {
            "rank": str(rank),
            "id": f"'{column}:{operator}:{argument}'",
            "label": f"'{label}'",
            "column_id": f"'{column}'",
            "operator": f"'{operator}'",
            "arguments": f"'string:{argument}'" if argument else "''",
            "result_count": count,
            "score": f"{score}::DOUBLE",
            "is_complete": str(bool(argument)),
            "completion_text": f"'{label}'",
            "category": f"'{category}'",
            "query_matches": f"'{matches}'",
        }
        out.append("SELECT " + ", ".join(f"{cell} AS {name}" for name, cell in cells.items()) + " FROM c")
    return f"WITH c AS ({counts}) " + " UNION ALL ".join(out)


# Two words, both explained: 0.4 for the column (1.0) and 0.4 for the value, which stands after a mark (0.95) and is six of eight
# characters (0.8 + 0.2 * 6/8).
_URGENT = "column:0:8:Priority:1.0,value:9:15:1-URGENT:0.9025"
_RANKED = [
    ("Priority equals 1-URGENT", "o_orderpriority", "eq", "1-URGENT", "urgent", 0.761, "equality", _URGENT),
    ("Priority not equals 1-URGENT", "o_orderpriority", "neq", "1-URGENT", "other", 0.761, "equality", _URGENT),
    ("Priority in 1-URGENT", "o_orderpriority", "in", "1-URGENT", "urgent", 0.761, "set_membership", _URGENT),
    ("Priority not in 1-URGENT", "o_orderpriority", "nin", "1-URGENT", "other", 0.761, "set_membership", _URGENT),
]


@query(_suggested(_RANKED, "SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority <> '1-URGENT') AS other FROM orders"))
def suggest_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _suggest(spark, folder, "priority urgent")


# Both words explained by column and value, each whole: 0.4 + 0.4. Then one word of two by a column that begins with it, one of five or seven
# characters: 0.5 * 0.4 * (0.8 + 0.2/5 or 0.2/7), with its first three operators; other columns begin with it in longer names.
_OPEN, _ORDER, _DATE = "column:0:6:Status:1.0,value:7:8:O:1.0", "column:7:8:Order:0.84", "column:7:8:ordered:0.828571"
_FIRST_THREE = (("eq", "equals", "equality"), ("neq", "not equals", "equality"), ("lt", "less than", "comparison"))
_IN_CONTEXT = [
    ("Status equals O", "o_orderstatus", "eq", "O", "open", 0.8, "equality", _OPEN),
    ("Status not equals O", "o_orderstatus", "neq", "O", "other", 0.8, "equality", _OPEN),
    ("Status in O", "o_orderstatus", "in", "O", "open", 0.8, "set_membership", _OPEN),
    ("Status not in O", "o_orderstatus", "nin", "O", "other", 0.8, "set_membership", _OPEN),
    *((f"Order {word}", "o_orderkey", operator, "", "open + other", 0.168, category, _ORDER) for operator, word, category in _FIRST_THREE),
    *((f"Date {word}", "o_orderdate", operator, "", "open + other", 0.165714, category, _DATE) for operator, word, category in _FIRST_THREE),
]
_IN_CONTEXT_COUNTS = """
SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus <> 'O') AS other FROM orders WHERE o_totalprice > 200000
"""


@query(_suggested(_IN_CONTEXT, _IN_CONTEXT_COUNTS))
def suggest_in_context(spark: SparkSession, folder: str) -> DataFrame:
    return _suggest(spark, folder, "status o", (FilterSpec("o_totalprice", "gt", (200000,)),))
