"""Queries that go through files: what a sink writes a source reads back."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select, sets
from ..session import folder
from ..sources import published, readers, writers
from ..streaming import notify, polls
from .registry import query
from .relations import BOXES_SQL, boxes, table


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name"), "n_regionkey")


def _written(spark: SparkSession, tag: str, rows: DataFrame, write) -> str:  # noqa: ANN001
    path = folder(spark, tag)
    write(rows, path)
    return path


PART = "p_partkey bigint, p_name string, p_size int"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name, p_size::INT AS p_size FROM part WHERE p_size > 10")
def q39_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_lines(spark, _written(spark, "lines", _parts(spark, sf_dir), writers.json_lines), PART).where("p_size > 10")


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name, p_size::INT AS p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def q40_json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").cast("long").alias("p_partkey"))
    return readers.json_lookup(spark, _written(spark, "lines", _parts(spark, sf_dir), writers.json_lines), keys, "p_partkey", PART)


def _documents(spark: SparkSession, rows: DataFrame, brackets: str, member: F.Column, document: F.Column) -> str:
    path = folder(spark, "documents")
    writers.json_documents(rows.select("p_partkey", member.alias("member"), document.alias("document")), path, brackets, "member", "p_partkey")
    return path


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name || ', \"[' AS p_name FROM part")
def q41_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of all parts, with brackets, commas and quotes in its texts."""
    rows = _parts(spark, sf_dir).withColumn("p_name", F.concat("p_name", F.lit(', "[')))
    return readers.json_array(spark, f"{_documents(spark, rows, '[]', F.to_json(F.struct('p_partkey', 'p_name')), F.lit(0))}/*", "p_partkey bigint, p_name string")


@query("SELECT p_partkey || ':{' AS sample, '<b>' || p_name || '</b>' AS html, p_size::VARCHAR AS type FROM part")
def q42_json_map_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by name in five files, read by a pattern of names."""
    value = F.to_json(F.struct(F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("html"), F.col("p_size").cast("string").alias("type")))
    member = F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit(':{": '), value)
    return readers.json_map(spark, f"{_documents(spark, _parts(spark, sf_dir), '{}', member, F.col('p_size') % 5)}/document=*")


@query("SELECT p_name AS sample, 'p' AS pred_html, 't' AS gt_html, p_partkey / 4e0 AS edit_distance, p_size / 8e0 AS teds_s, 1e0 AS teds FROM part")
def q43_positional_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.array("p_name", F.lit("p"), F.lit("t"), (F.col("p_partkey") / 4).cast("string"), (F.col("p_size") / 8).cast("string"), F.lit("1.0")))
    return readers.positional_scores(spark, _documents(spark, _parts(spark, sf_dir), "[]", row, F.lit(0)))


@query("""SELECT p_partkey::BIGINT AS p_partkey, replace(p_name, ' ', ', "') AS p_name, p_size::INT AS p_size FROM part""")
def q44_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with separators and quotes."""
    rows = _parts(spark, sf_dir).withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit(', "')))
    return spark.read.schema(PART).option("escape", '"').csv(_written(spark, "csv", rows, writers.csv), header=True)


@query("SELECT p_partkey::BIGINT AS p_partkey, p_size::INT AS p_size FROM part")
def q44b_plain_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.csv(spark, _written(spark, "csv", _parts(spark, sf_dir).select("p_partkey", "p_size"), writers.csv), "p_partkey bigint, p_size int")


_TSV = """tsv AS (SELECT CASE WHEN idx % 5 = 4 THEN '  ' ELSE ' ' || text || sample END AS text, CASE idx % 4 WHEN 0 THEN '96' WHEN 1 THEN '-1' WHEN 2 THEN '87.5' ELSE 'x' END AS conf, x0, y0, x1 - x0 AS width, y1 - y0 AS height FROM boxes)"""


def _tsv(spark: SparkSession, sf_dir: str) -> str:
    b, i = F.col("box"), F.col("idx")
    conf = F.element_at(F.array(*map(F.lit, ("96", "-1", "87.5", "x"))), i % 4 + 1)
    text = F.when(i % 5 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.col("sample").cast("string")))
    rows = boxes(spark, sf_dir).select(text.alias("text"), conf.alias("conf"), b["x0"].alias("left"), b["y0"].alias("top"), (b["x1"] - b["x0"]).alias("width"), (b["y1"] - b["y0"]).alias("height"))
    return _written(spark, "tsv", rows, lambda r, p: r.write.csv(p, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def _words(rows: DataFrame) -> DataFrame:
    return rows.select("text", "score", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


_BOX = "x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + width)::DOUBLE AS x1, (y0 + height)::DOUBLE AS y1"


@query(f"{BOXES_SQL}, {_TSV} SELECT trim(text) AS text, conf::DOUBLE AS score, {_BOX} FROM tsv WHERE trim(text) <> '' AND conf IN ('96', '87.5')")
def q45_recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(readers.recognised_words(spark, _tsv(spark, sf_dir)))


@query(f"{BOXES_SQL}, {_TSV} SELECT trim(text) AS text, CASE conf WHEN '96' THEN 0.96e0 ELSE 1e0 END AS score, {_BOX} FROM tsv WHERE trim(text) <> '' AND x0 + width / 2e0 BETWEEN 10 AND 40 AND y0 + height / 2e0 BETWEEN 5 AND 30")
def q46_words_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.lit(10).alias("x0"), F.lit(5).alias("y0"), F.lit(40).alias("x1"), F.lit(30).alias("y1"))
    return _words(readers.words_in_table(readers.recognised_words(spark, _tsv(spark, sf_dir), keep_unsure=True), place))


@query("SELECT DISTINCT unnest([p_name, p_name || '.png']) AS name FROM part")
def q47_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment, an empty line and a name, in each of its forms with blanks around it, for each part."""
    lines = F.array(F.lit("# names"), F.lit(""), F.col("p_name"), F.concat(F.lit("  "), "p_name", F.lit(".png ")))
    path = _written(spark, "names", _parts(spark, sf_dir).select(F.explode(lines).alias("value")), lambda r, p: r.write.text(p))
    return readers.name_list(spark, path, comments=True, both_forms=True)


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "files")
    where = F.concat(F.lit(f"{path}/region_"), F.col("n_regionkey").cast("string"), F.lit("/nation_"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    writers.by_file(_nations(spark, sf_dir).select(where.alias("path"), F.col("n_name").alias("text")))
    return path


@query("SELECT sha256(n_name) AS sha256, length(n_name)::BIGINT AS size_bytes, n_regionkey::VARCHAR AS region, n_nationkey::VARCHAR AS nation FROM nation")
def q48_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.files(spark, _nation_files(spark, sf_dir), "*.txt", region="region_([0-9]+)/", nation="nation_([0-9]+)").drop("path")


@query("SELECT length(n_name)::BIGINT AS size_bytes, n_regionkey::VARCHAR AS region FROM nation")
def q48b_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.files(spark, _nation_files(spark, sf_dir), content=False, region="region_([0-9]+)/").drop("path")


@query("SELECT 'nation_' || n_nationkey AS sample, n_name AS value FROM nation")
def q49_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.by_stem(spark.read.option("recursiveFileLookup", True).text(_nation_files(spark, sf_dir)))


@query("SELECT p_partkey::BIGINT AS p_partkey FROM part")
def q50_sniffed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _written(spark, "lines", _nations(spark, sf_dir), writers.json_lines)
    good = _written(spark, "lines", _parts(spark, sf_dir), writers.json_lines)
    return readers.require_columns(readers.json_lines(spark, readers.sniffed(spark, [other, good], ["p_partkey", "p_name"]), PART), ["p_partkey"]).select("p_partkey")


@query("SELECT p_partkey::BIGINT AS key, (p_partkey % 3 + 1)::BIGINT AS found, p_partkey / 2e0 AS first FROM part")
def q51_nested_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects at several depths: below members, in lists of lists, and beside other things."""
    k = F.col("p_partkey")
    one = F.concat(F.lit('{"bbox": ['), (k / 2).cast("string"), F.lit('], "tokens": ["a"]}'))
    more = F.when(k % 3 == 2, F.concat_ws(", ", one, one)).when(k % 3 == 1, one).otherwise(F.lit(""))
    document = F.concat(F.lit('{"page": {"x": 1, "deep": [[['), one, F.lit(']]]}, "rest": ['), more, F.lit("]}"))
    rows = _parts(spark, sf_dir).select(k.alias("key"), readers.boxed_tokens(document).alias("b"))
    return rows.select("key", F.size("b").cast("long").alias("found"), F.col("b")[0]["bbox"][0].alias("first"))


@query("SELECT count(*) + 0 AS there, 0::BIGINT AS absent FROM nation")
def q52_optional_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _written(spark, "lines", _nations(spark, sf_dir), writers.json_lines)
    count = lambda path, name: readers.optional(spark, path, "n_name string").agg(F.count("*").alias(name))
    return count(there, "there").join(count(f"{there}-none", "absent"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) ELSE 'none' END AS text FROM nation")
def q53_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _nations(spark, sf_dir).select(k.cast("long"), readers.first_text(F.when(k % 3 == 0, F.col("n_name")), F.when(k % 3 == 1, F.upper("n_name")).otherwise(""), F.lit("none")).alias("text"))


@query("SELECT p_partkey::BIGINT AS key, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END AS text, p_partkey % 4 >= 2 AS from_new, p_partkey % 4 = 1 AS empty FROM part")
def q54_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    new, old = F.when(k % 4 >= 2, F.col("p_name")).when(k % 4 == 1, F.lit("  ")), F.when(k % 4 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select(k.cast("long").alias("key"), sets.text_or_fallback(new, old).alias("t")).select("key", "t.*")


@query("SELECT '{\n  \"n\": ' || count(*) || ',\n  \"first\": \"' || min(n_name) || '\"\n}' AS document FROM nation")
def q55_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = writers.summary_json(_nations(spark, sf_dir).agg(F.count("*").alias("n"), F.min("n_name").alias("first")))
    return spark.createDataFrame([(text,)], "document string")


@query("SELECT n_nationkey - 0 AS place, n_name || chr(9) || n_regionkey AS line FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS n_nationkey, n_name, n_regionkey FROM nation)")
def q56_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "manifest", _nations(spark, sf_dir).select("n_name", "n_regionkey"), lambda r, p: writers.manifest(r, p, "n_name"))
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return sets.numbered(lines, ["line"], 4).select(F.col("index").alias("place"), "line")


@query("SELECT '| n_name | half |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || printf('%.4f', n_nationkey / 2e0) || ' |', chr(10) ORDER BY n_name) || chr(10) AS document FROM nation")
def q57_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = writers.markdown(_nations(spark, sf_dir).orderBy("n_name").select("n_name", (F.col("n_nationkey") / 2).alias("half")))
    return spark.createDataFrame([(text,)], "document string")


@query("SELECT string_agg('<tr><td>&lt;' || n_name || '&gt;</td></tr>', '' ORDER BY n_name) AS rows, 2::BIGINT AS headings FROM nation")
def q58_html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = writers.html_report("R&D", {"Nations": _nations(spark, sf_dir).orderBy("n_name").select(F.concat(F.lit("<"), "n_name", F.lit(">")).alias("name"))})
    rows = spark.createDataFrame([(text,)], "t string")
    return rows.select(F.regexp_extract("t", "<tbody>(.*)</tbody>", 1).alias("rows"), F.regexp_count("t", F.lit("R&amp;D")).cast("long").alias("headings"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def q59_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))
    return spark.read.parquet(_written(spark, "split", rows, writers.by_split)).groupBy(F.col("split").alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT (o_orderkey % 8)::INT AS shard, count(*) AS rows, min(o_orderkey)::BIGINT AS first, max(o_orderkey)::BIGINT AS last FROM orders GROUP BY 1")
def q60_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"), sets.modulo_shard(F.col("o_orderkey"), 8).alias("shard"))
    return writers.by_shard(rows, folder(spark, "shard"), "shard", "o_orderkey")


@query("SELECT p_partkey::BIGINT AS p_partkey, p_size::INT AS p_size, p_size * 2::BIGINT AS twice FROM part")
def q61_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _written(spark, "lines", _parts(spark, sf_dir), writers.json_lines), folder(spark, "lines")
    published.write_back(readers.json_lines(spark, source, PART), source, target, twice=F.col("p_size") * 2)
    return published.published(spark, target, f"{PART}, twice bigint", "json").drop("p_name")


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name, p_size::INT AS p_size, (SELECT count(*) FROM part WHERE p_size <= 25) AS first, (SELECT count(*) FROM part WHERE p_size > 25) AS second FROM part")
def q61b_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published in two commits, the first of them twice, beside a job that fails: each row is seen once, with the commits' numbers of rows."""
    rows, target = _parts(spark, sf_dir), folder(spark, "commits")
    small, large = rows.where("p_size <= 25"), rows.where("p_size > 25")
    sizes = [published.publish(part, target, name).rows for part, name in ((small, "1"), (large, "2"), (small, "1"))]
    with contextlib.suppress(Exception):
        published.publish(rows.withColumn("p_size", F.when(F.col("p_size") > 25, F.raise_error(F.lit("broken"))).otherwise(F.col("p_size"))), target, "3")
    return published.published(spark, target, PART).withColumns({"first": F.lit(sizes[0]).cast("long"), "second": F.lit(sizes[1]).cast("long")})


@query("SELECT false AS before, true AS after, count(*) AS rows FROM nation")
def q62_ready_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "lines", _nations(spark, sf_dir), writers.json_lines)
    before = writers.is_ready(spark, path)
    writers.mark_ready(spark, path)
    return spark.read.json(path).agg(F.lit(before).alias("before"), F.lit(writers.is_ready(spark, path)).alias("after"), F.count("*").alias("rows"))


_LINT = """files AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name || ' password = hunter' || s_suppkey WHEN 2 THEN 'api_key: ' || repeat('k', (s_suppkey % 40)::INT) ELSE repeat('x', (s_suppkey % 300)::INT) END AS text,
  'f' || s_suppkey || CASE WHEN s_suppkey % 6 = 0 THEN '.pkl' ELSE '.txt' END AS file FROM supplier)"""


@query(f"""WITH {_LINT} SELECT file, 'password' AS rule FROM files WHERE regexp_matches(text, 'password = [a-z]+[0-9]+') UNION ALL SELECT file, 'key' FROM files WHERE regexp_matches(text, 'api_key: k{{8,}}')
UNION ALL SELECT file, 'suffix .pkl' FROM files WHERE ends_with(file, '.pkl') UNION ALL SELECT file, 'size' FROM files WHERE length(text) > 120""")
def q63_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier: plain ones, some with secrets, long ones, and names that are not wanted."""
    path, k = folder(spark, "lint"), F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.col("s_name")).when(k % 4 == 1, F.concat("s_name", F.lit(" password = hunter"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("api_key: "), F.repeat(F.lit("k"), (k % 40).cast("int")))).otherwise(F.repeat(F.lit("x"), (k % 300).cast("int")))
    name = F.concat(F.lit(f"{path}/f"), k.cast("string"), F.when(k % 6 == 0, F.lit(".pkl")).otherwise(F.lit(".txt")))
    writers.by_file(table(spark, sf_dir, "supplier").select(name.alias("path"), text.alias("text")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = select.lint(files, {"password": "password = [a-z]+[0-9]+", "key": "api_key: k{8,}"}, [".pkl"], 120)
    return found.select(F.substring_index("path", "/", -1).alias("file"), "rule")


@query("SELECT event_type, count(*)::BIGINT AS once FROM (SELECT DISTINCT event_type FROM events) GROUP BY 1")
def q64_notified_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls.once(table(spark, sf_dir, "events").select("event_type"), "event_type").groupBy("event_type").agg(F.count("*").alias("once"))


#: In which of two runs of a stream a file is there: by the event's number.
_HALVES = "e AS (SELECT *, event_id % 2 AS half, epoch_us(ts) AS us FROM events)"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, half bigint"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long"), "event_type", F.col("value").cast("double"), (F.col("event_id") % 2).cast("long").alias("half"))


def _two_runs(spark: SparkSession, rows: DataFrame, schema: str, out: str, start) -> DataFrame:  # noqa: ANN001
    """What a stream publishes that runs over the first half's files, stops, and runs again when the second half's are there too."""
    source, checkpoint, target = (folder(spark, x) for x in ("stream", "offsets", "notices"))
    for half in (0, 1):
        rows.where(F.col("half") == half).write.mode("append").parquet(source)
        start(notify.files_stream(spark, source, schema), checkpoint, target)
    return published.published(spark, target, f"{out}, batch long")


@query(f"""WITH {_HALVES}, a AS (SELECT CASE WHEN event_type = 'error' THEN 'bad-' || user_id || '-error' WHEN event_type = 'purchase' THEN 'done-' || user_id END AS key, CASE WHEN event_type = 'error' THEN 'problem: error' ELSE 'completed' END AS title, half FROM e)
SELECT key, title, min(half)::BIGINT AS run FROM a WHERE key IS NOT NULL GROUP BY 1, 2""")
def q64b_notified_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of errors and purchases by user, once over two runs of one stream; run: the run that sent it."""

    def start(found: DataFrame, checkpoint: str, target: str) -> None:
        jobs = notify.alerts(found, F.col("event_type") == "error", F.col("event_type") == "purchase", "user_id", "event_type")
        notify.notify_once(jobs.select("key", "title"), checkpoint, target)

    sent = _two_runs(spark, _events(spark, sf_dir), EVENT, "key string, title string", start)
    return sent.select("key", "title", F.when(F.col("batch") > 0, 1).otherwise(0).cast("long").alias("run"))


@query("""WITH p AS (SELECT event_type, day, least(4, n // 2) AS files FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)),
c AS (SELECT *, CASE WHEN lag(files) OVER w IS NOT DISTINCT FROM files THEN 0 ELSE 1 END AS c FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day)),
i AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS i FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, i ORDER BY day) AS run FROM i)
SELECT event_type AS key, min(day)::VARCHAR AS at, arg_min(files, day)::BIGINT AS count FROM r WHERE files >= 1 AND run >= 2 GROUP BY 1""")
def q30b_stable_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first poll of each kind of event at which a day's count has come twice, over two runs of one stream that is cut in the middle of the days."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.least(F.lit(4), F.floor(F.count("*") / 2)).cast("long").alias("files"))
    days = counts.select("day").distinct().agg(F.median(F.unix_date("day")).alias("m"))
    rows = counts.withColumn("half", (F.unix_date("day") >= days.scalar()).cast("long")).withColumn("day", F.col("day").cast("string"))
    start = lambda found, checkpoint, target: notify.watch_stable(found, checkpoint, target, "event_type", "day", "files", 1, 2)
    return _two_runs(spark, rows, "event_type string, day string, files long, half long", "key string, at string, count long", start).drop("batch")
