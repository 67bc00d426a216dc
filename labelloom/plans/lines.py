"""JSONL queries: scans, counts, balance, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions.text import stripped
from labelloom.operators import quality, resample, series
from labelloom.operators.labelling import label_requests, render_examples
from labelloom.plans import oracle as O
from labelloom.plans import views as V
from labelloom.plans.catalogue import query
from labelloom.sources import jsonl
from labelloom.sources.session import settled, work_path


def _written_lines(spark, sf, rows=None):
    """Example lines written as text files in the shared folder."""
    path = work_path(spark, "lines")
    jsonl.write_lines(V.example_lines(spark, sf) if rows is None else rows, path)
    return path


def _text_digest(*columns):
    """Order-free digest of a set of texts."""
    word = F.conv(F.substring(F.md5(F.concat(*columns)), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(F.sum(word), F.lit(0))


_DIGEST = "coalesce(sum(('0x'||substr(md5({0}),1,8))::BIGINT),0)::BIGINT"


@query("jsonl_strict", O.sql(["lines"], f"""
SELECT count(*)::BIGINT AS rows, {_DIGEST.format("prompt||completion")} AS digest FROM lines"""))
def jsonl_strict(spark, sf):
    path = work_path(spark, "strict")
    jsonl.write_examples(V.examples(spark, sf), path)
    rows = jsonl.strict_examples(jsonl.read_numbered_lines(spark, path))
    return rows.agg(F.count("*").alias("rows"), _text_digest("prompt", "completion").alias("digest"))


@query("jsonl_counting", O.sql(["lines"], """
SELECT count_if(kind NOT IN (1,2))::BIGINT AS total, count_if(kind IN (0,5))::BIGINT AS unreadable,
       count_if(kind IN (3,4))::BIGINT AS no_object, count_if(kind IN (7,8) OR kind > 8)::BIGINT AS with_texts FROM lines"""))
def jsonl_counting(spark, sf):
    marked = jsonl.mark_lines(jsonl.read_lines(spark, _written_lines(spark, sf)))
    texts = F.col("prompt").isNotNull() & F.col("completion").isNotNull()
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("json_ok")).alias("unreadable"),
        F.count_if(F.col("json_ok") & ~F.col("is_object")).alias("no_object"),
        F.count_if(texts).alias("with_texts"),
    )


@query("jsonl_dropping", O.sql(["lines"], """
SELECT count_if(kind NOT IN (0,1,2,5))::BIGINT AS evaluated, count_if(kind > 6)::BIGINT AS classed FROM lines"""))
def jsonl_dropping(spark, sf):
    """Both dropping rules: unreadable lines only, or all lines without a class."""
    marked = jsonl.mark_lines(jsonl.read_lines(spark, _written_lines(spark, sf)))
    return quality.with_class(marked).agg(
        F.count_if("json_ok").alias("evaluated"), F.count("class").alias("classed")
    )


@query("jsonl_roundtrip", O.sql(["examples"], f"""
SELECT count(*)::BIGINT AS rows, {_DIGEST.format("prompt")} AS prompts, {_DIGEST.format("completion")} AS completions FROM examples"""))
def jsonl_roundtrip(spark, sf):
    path = work_path(spark, "roundtrip")
    jsonl.write_examples(V.examples(spark, sf), path)
    back = spark.read.schema(jsonl.EXAMPLE_SCHEMA).option("mode", "FAILFAST").json(path)
    return back.agg(
        F.count("*").alias("rows"), _text_digest("prompt").alias("prompts"), _text_digest("completion").alias("completions")
    )


@query("jsonl_glob", O.sql(["examples"], f"""
SELECT CASE WHEN request_id % 11 = 10 THEN 'eval' ELSE 'train' END AS split, count(*)::BIGINT AS rows,
       {_DIGEST.format("prompt")} AS digest FROM examples GROUP BY 1"""))
def jsonl_glob(spark, sf):
    """All ``*.jsonl`` tables under a dataset folder; the name is the split."""
    root = work_path(spark, "dataset")
    name = F.when(F.col("request_id") % 11 == 10, "eval.jsonl").otherwise("train.jsonl")
    line = jsonl.json_line(F.col("prompt"), F.col("completion"))
    V.examples(spark, sf).select(name.alias("name"), line.alias("value")).write.partitionBy("name").text(
        root, lineSep="\n"
    )
    lines = jsonl.read_lines(spark, f"{root}/*.jsonl")
    marked = jsonl.mark_lines(lines).withColumn("split", F.regexp_extract("path", r"name=(\w+)\.jsonl/", 1))
    return marked.groupBy("split").agg(F.count("*").alias("rows"), _text_digest("prompt").alias("digest"))


FILE_LINES = 5_000


@query("line_numbers", O.sql(["lines"], f"""
SELECT request_id // {FILE_LINES} AS file_no, row_number() OVER (PARTITION BY request_id // {FILE_LINES} ORDER BY request_id) AS line_no,
       kind IN (1,2) AS blank FROM lines"""))
def line_numbers(spark, sf):
    """Line numbers of files that hold a fixed range of ids each, in id order."""
    path = work_path(spark, "numbered")
    file_no = F.floor(F.col("request_id") / FILE_LINES).alias("file_no")
    rows = V.example_lines(spark, sf).select("request_id", file_no, "value")
    ordered = rows.repartition("file_no").sortWithinPartitions("file_no", "request_id")
    ordered.select("file_no", "value").write.partitionBy("file_no").text(path)
    numbered = jsonl.read_numbered_lines(spark, path)
    return numbered.select(
        F.regexp_extract("path", r"file_no=(\d+)", 1).cast("bigint").alias("file_no"),
        "line_no",
        (stripped(F.col("value")) == "").alias("blank"),
    )


_CHECKED = "kind NOT IN (1,2)"
_VALID = "kind > 8"


def _checked(spark, sf):
    return quality.with_validity(jsonl.mark_lines(V.stored_lines(spark, sf)))


@query("validate_counts", O.sql(["lines"], f"""
SELECT count_if({_CHECKED})::BIGINT AS total, count_if({_VALID})::BIGINT AS valid,
       count_if({_CHECKED} AND NOT {_VALID})::BIGINT AS invalid FROM lines"""))
def validate_counts(spark, sf):
    return quality.validity_counts(_checked(spark, sf))


@query("error_sample", O.sql(["lines"], """
SELECT request_id, greatest((SELECT count(*) FROM bad) - 10, 0)::BIGINT AS more FROM bad ORDER BY request_id LIMIT 10
""", bad=f"SELECT request_id FROM lines WHERE {_CHECKED} AND NOT {_VALID}"))
def error_sample(spark, sf):
    return quality.first_errors(_checked(spark, sf), "request_id").select("request_id", "more")


@query("head_sample", O.sql(["examples"], "SELECT request_id, prompt FROM examples ORDER BY request_id LIMIT 20"))
def head_sample(spark, sf):
    """The first scenes are taken before any prompt is made."""
    first = series.head(V.scenes(spark, sf), "request_id", 20)
    return render_examples(label_requests(first)).select("request_id", "prompt")


_FLAGS = {
    "b": "SELECT class, n, sum(n) OVER ()::BIGINT AS total FROM c",
    "f": """SELECT *, n/total AS share, CASE WHEN total < 50 THEN '' WHEN n/total < 0.05 THEN 'UNDER'
            WHEN n/total > 0.25 THEN 'OVER' ELSE '' END AS flag FROM b""",
}


def _label_classes(body):
    return O.sql([], body, c="SELECT quality||'_'||toxic AS class, count(*)::BIGINT AS n FROM labels GROUP BY 1", **_FLAGS)


def _action_classes(body):
    named = "CASE WHEN kind = 8 THEN 'FLY' ELSE action END"
    return O.sql(["lines"], body, c=f"SELECT {named} AS class, count(*)::BIGINT AS n FROM lines WHERE kind > 6 GROUP BY 1", **_FLAGS)


def _label_class(spark, sf):
    both = F.concat_ws("_", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return V.table(spark, sf, "labels").select("doc_id", both.alias("class"))


def _line_class(spark, sf):
    marked = jsonl.mark_lines(V.stored_lines(spark, sf))
    return quality.with_class(marked).select("request_id", "class")


@query("class_balance", _action_classes("SELECT class, n, total, share, flag FROM f"))
def class_balance(spark, sf):
    return quality.class_balance(_line_class(spark, sf), "class")


@query("class_balance_labels", _label_classes("SELECT class, n, total, share, flag FROM f"))
def class_balance_labels(spark, sf):
    return quality.class_balance(_label_class(spark, sf), "class")


@query("balance_gate", _action_classes("""
SELECT count(*)::BIGINT AS classes, coalesce(sum(n),0)::BIGINT AS rows, count_if(flag='UNDER')::BIGINT AS under,
       count_if(flag='OVER')::BIGINT AS over, count_if(flag<>'') = 0 AS passed FROM f"""))
def balance_gate(spark, sf):
    return quality.balance_gate(class_balance(spark, sf))


@query("balance_violations", _label_classes("""
SELECT class, flag, class||CASE flag WHEN 'UNDER' THEN ' underrepresented (' ELSE ' overrepresented (' END||printf('%.1f', share*100)||
       CASE flag WHEN 'UNDER' THEN '% < 5%)' ELSE '% > 25%)' END AS message FROM f WHERE flag <> ''"""))
def balance_violations(spark, sf):
    return quality.balance_violations(class_balance_labels(spark, sf))


@query("class_weights", """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, event_type, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) AS weight
FROM events JOIN c USING (event_type)""")
def class_weights(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", "event_type")
    return quality.class_weights(rows, "event_type").select("event_id", "event_type", "weight")


@query("class_weights_lines", O.sql(["lines"], """
SELECT request_id, class, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) AS weight FROM m JOIN c USING (class)""",
    m="""SELECT request_id, CASE WHEN kind = 8 THEN 'FLY' WHEN kind > 6 THEN action ELSE 'IDLE' END AS class
         FROM lines WHERE kind NOT IN (1,2)""",
    c="SELECT class, count(*) AS n FROM m GROUP BY 1"))
def class_weights_lines(spark, sf):
    """Weights of example lines; a line without a readable class counts as idle."""
    marked = jsonl.mark_lines(V.stored_lines(spark, sf))
    rows = settled(quality.with_class(marked, strict=False).select("request_id", "class"))
    return quality.class_weights(rows, "class").select("request_id", "class", "weight")


def _copies_sql(u: str, rate: str) -> str:
    import math

    hits = []
    for k in range(resample.MAX_COPIES):
        terms = " + ".join(f"pow({rate},{j})/{float(math.factorial(j))}::DOUBLE" for j in range(k + 1))
        hits.append(f"(CASE WHEN {u} >= exp(-{rate})*({terms}) THEN 1 ELSE 0 END)")
    return "+".join(hits)


@query("weighted_resample", f"""
WITH w AS (SELECT doc_id, quality||'_'||toxic AS class FROM labels),
c AS (SELECT class, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT doc_id, class, floor((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) * 1e12 + 0.5)::BIGINT AS units
      FROM w JOIN c USING (class)),
l AS (SELECT *, coalesce(sum(units) OVER (ORDER BY md5(doc_id::VARCHAR), class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
p AS (SELECT (('0x'||substr(md5('42:'||j||':draw'),1,12))::HUGEINT * (SELECT sum(units) FROM r)::HUGEINT // 281474976710656)::BIGINT AS at
      FROM range((SELECT count(*) FROM w)) t(j))
SELECT l.doc_id, l.class, count(*)::BIGINT AS copies FROM p ASOF JOIN l ON p.at >= l.start GROUP BY 1, 2""")
def weighted_resample(spark, sf):
    """As many draws as there are labels; each class is as likely as any other."""
    rows = quality.class_weights(_label_class(spark, sf), "class")
    drawn = resample.resample_exactly(rows, 42, "doc_id")
    return drawn.groupBy("doc_id", "class").agg(F.count("*").alias("copies"))


@query("poisson_resample", f"""
WITH w AS (SELECT doc_id, quality||'_'||toxic AS class FROM labels),
c AS (SELECT class, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT doc_id, class, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) AS weight FROM w JOIN c USING (class)),
p AS (SELECT doc_id, class, p AS piece, least(1.0, weight - (p - 1)) AS rate FROM r, unnest(range(1, ceil(weight)::BIGINT + 1)) t(p)),
k AS (SELECT doc_id, class, {_copies_sql(O.draw(42, "doc_id", "'copies-'||piece"), "rate")} AS n FROM p)
SELECT doc_id, class, sum(n)::BIGINT AS copies FROM k GROUP BY 1, 2 HAVING sum(n) > 0""")
def poisson_resample(spark, sf):
    rows = quality.class_weights(_label_class(spark, sf), "class")
    drawn = resample.weighted_resample(rows, 42, "doc_id")
    return drawn.groupBy("doc_id", "class").agg(F.count("*").alias("copies"))
