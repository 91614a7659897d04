"""Registered queries over the given tables, which carry payloads, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, tables
from ..functions.content import parse_content
from ..operators import codec, encode, relational, scan, scenes
from ..sources import frames
from ..streaming import scanner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "q_content_types",
    """SELECT c_custkey, ['tel','sms','geo','wifi','email','email','url','vcard','text'][k + 1] AS type,
  CASE k WHEN 0 THEN '+' || c_custkey WHEN 1 THEN '' || c_custkey WHEN 3 THEN c_name WHEN 4 THEN c_name WHEN 5 THEN c_mktsegment
    WHEN 6 THEN 'https://example.org/' || c_custkey WHEN 7 THEN c_name WHEN 8 THEN c_name END AS value,
  CASE k WHEN 2 THEN (c_custkey % 90)::DOUBLE END AS latitude
FROM (SELECT *, c_custkey % 9 AS k FROM customer)""",
)
def q_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.expr("""CASE c_custkey % 9 WHEN 0 THEN concat('tel:+', c_custkey) WHEN 1 THEN concat('SMSTO:', c_custkey, ':hello')
      WHEN 2 THEN concat('geo:', c_custkey % 90, ',', c_nationkey) WHEN 3 THEN concat('WIFI:T:WPA;S:', c_name, ';P:x;;')
      WHEN 4 THEN concat('mailto:', replace(c_name, '#', '%23'), '?subject=a+b') WHEN 5 THEN concat('MATMSG:TO:', c_mktsegment, ';SUB:hi;;')
      WHEN 6 THEN concat('https://example.org/', c_custkey) WHEN 7 THEN concat('BEGIN:VCARD\\nFN:', c_name, '\\nEND:VCARD') ELSE c_name END""")
    c = parse_content(F.col("payload"))
    parsed = read(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload")).select("c_custkey", c.alias("c"))
    return parsed.select("c_custkey", "c.type", F.coalesce("c.number", "c.ssid", "c.email_to", "c.url", "c.name", "c.text").alias("value"), "c.latitude")


@query("q_content_pages", "SELECT page_id, CASE WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^\\s/?#:@]+(:[0-9]+)?([/?#].*)?$') THEN 'url' ELSE 'text' END AS type FROM pages")
def q_content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", parse_content(F.col("url"))["type"].alias("type"))


@query(
    "q_gs1",
    """SELECT p_partkey, 0 AS place, '01' AS ai, lpad(p_partkey::VARCHAR, 14, '0') AS value FROM part
UNION ALL SELECT p_partkey, 1, '10', p_brand FROM part
UNION ALL SELECT p_partkey, 2, '17', '2601' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') FROM part
UNION ALL SELECT p_partkey, 3, '3103', lpad(p_size::VARCHAR, 6, '0') FROM part""",
)
def q_gs1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('01', lpad(p_partkey, 14, '0'), '10', p_brand, char(29), '172601', lpad(1 + p_partkey % 28, 2, '0'), '3103', lpad(p_size, 6, '0'))")
    found = read(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", F.posexplode(parse_content(F.col("t"), True)["elements"]).alias("place", "e"))
    return found.select("p_partkey", "place", "e.ai", "e.value")


@query("q_wifi_escape", "SELECT s_suppkey, s_name || ';' || s_suppkey AS ssid, 'a:b\\c' AS password, s_suppkey % 2 = 0 AS hidden FROM supplier")
def q_wifi_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("WIFI:T:wpa;S:"), F.col("s_name"), F.lit("\\;"), F.col("s_suppkey"), F.lit(";P:a\\:b\\\\c;H:"), (F.col("s_suppkey") % 2 == 0).cast("string"), F.lit(";;"))
    c = read(spark, sf_dir, "supplier").select("s_suppkey", parse_content(text).alias("c"))
    return c.select("s_suppkey", "c.ssid", "c.password", F.coalesce("c.hidden", F.lit(False)).alias("hidden"))


@query(
    "q_dedupe",
    """SELECT event_id, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) >= 86400000, true) AS emit FROM events""",
)
def q_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanner.deduplicate(read(spark, sf_dir, "events"), ["event_type", "user_id"], window_ms=86_400_000, order=["event_id"]).select("event_id", "emit")


@query(
    "q_throttle",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT event_id, user_id, n, ms AS last, true AS taken FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.ms - t.last >= 21600000 THEN e.ms ELSE t.last END, e.ms - t.last >= 21600000
  FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT event_id, user_id FROM t WHERE taken""",
)
def q_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanner.throttle(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], 1 / 21600, order=["event_id"]).select("event_id", "user_id")


@query("q_structured_append", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE doc_id % 7 > 1 AND length(text) >= 4")
def q_structured_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").filter(F.length("text") >= 4)
    docs = docs.withColumn("total", (2 + F.col("doc_id") % 3).cast("int")).withColumn("parity", scanner.xor_bytes(F.col("text").cast("binary")).bitwiseXOR((F.col("doc_id") % 7 == 1).cast("int")))
    each = F.ceil(F.length("text") / F.col("total")).cast("int")
    parts = docs.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("total") - 1))).filter((F.col("doc_id") % 7 != 0) | (F.col("index") < F.col("total") - 1))
    parts = parts.withColumn("text", F.substring(F.col("text"), F.col("index") * each + 1, each)).withColumn("bytes", F.col("text").cast("binary"))
    parts = parts.withColumn("ts", F.timestamp_millis(((F.col("index") * 7 + F.col("doc_id")) % 5 * 1000)))
    joined = scanner.reassemble(parts, ["doc_id"], order=["index"])
    return joined.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "q_sa_expiry",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations))
WHERE turn % 2 = 1 AND before = turn - 1 AND conv_id % 3 < 2""",
)
def q_sa_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    ms = F.expr("(turn div 2) * 1000000 + (turn % 2) * (29999 + conv_id % 3)")
    parts = turns.select("conv_id", "turn", F.timestamp_millis(ms).alias("ts"), (F.col("turn") % 2).cast("int").alias("index"), F.lit(2).alias("total"), F.lit(0).alias("parity"), F.lit("x").alias("text"), F.unhex(F.lit("")).alias("bytes"))
    return scanner.reassemble(parts, ["conv_id"], order=["turn"]).select("conv_id", "turn")


@query(
    "q_mask_density",
    """WITH g AS (SELECT i // 177 AS r, i % 177 AS c, m FROM range(31329) t(i), range(8) u(m))
SELECT m::INTEGER AS mask, sum((CASE m WHEN 0 THEN (r + c) % 2 = 0 WHEN 1 THEN r % 2 = 0 WHEN 2 THEN c % 3 = 0 WHEN 3 THEN (r + c) % 3 = 0
  WHEN 4 THEN (r // 2 + c // 3) % 2 = 0 WHEN 5 THEN r * c % 2 + r * c % 3 = 0 WHEN 6 THEN (r * c % 2 + r * c % 3) % 2 = 0
  ELSE ((r + c) % 2 + r * c % 3) % 2 = 0 END)::INTEGER)::BIGINT AS dark FROM g GROUP BY m""",
)
def q_mask_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(177 * 177).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = exprs.mask_bit(F.col("mask"), F.floor(F.col("id") / 177), F.col("id") % 177)
    return cells.groupBy("mask").agg(F.sum(bit.cast("int")).alias("dark"))


@query("q_bch_nearest", "SELECT o_orderkey, (o_orderkey % 32)::INTEGER AS data, (o_orderkey % 4)::INTEGER AS distance FROM orders")
def q_bch_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flips = F.expr("shiftleft(shiftleft(1, cast(o_orderkey % 4 as int)) - 1, cast(o_orderkey % 11 as int))")
    read_ = exprs.format_codeword(F.col("o_orderkey") % 32).bitwiseXOR(flips)
    found = read(spark, sf_dir, "orders").select("o_orderkey", read_.alias("bits")).select("o_orderkey", exprs.nearest(F.col("bits"), list(enumerate(tables.FORMATS))).alias("f"))
    return found.select("o_orderkey", "f.data", "f.distance")


def _clmul(source: str, more: str = "") -> str:
    """WITH steps from ab (a, b, more) to p7, where p is the product of a and b: carry-less, then reduced bit by bit."""
    out = "0"
    for i in range(8):
        out = f"xor({out}, CASE WHEN (b >> {i}) & 1 = 1 THEN a << {i} ELSE 0 END)"
    steps = [f"ab AS ({source})", f"p0 AS (SELECT {more}a, b, {out} AS p FROM ab)"]
    for k, i in enumerate(range(14, 7, -1)):
        steps.append(f"p{k + 1} AS (SELECT {more}a, b, CASE WHEN (p >> {i}) & 1 = 1 THEN xor(p, {0x11D << (i - 8)}) ELSE p END AS p FROM p{k})")
    return ", ".join(steps)


@query("q_gf_mul", f"WITH {_clmul('SELECT l_partkey % 256 AS a, l_suppkey % 256 AS b FROM lineitem')} SELECT a, b, p AS product, count(*) AS n FROM p7 GROUP BY a, b, p")
def q_gf_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).alias("a"), (F.col("l_suppkey") % 256).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.select("a", "b", exprs.gf_mul(F.col("a").cast("int"), F.col("b").cast("int")).cast("bigint").alias("product"), "n")


@query(
    "q_ec_capacity",
    """SELECT v::INTEGER AS version, l AS ec_level, (((16 * v + 128) * v + 64
  - CASE WHEN v > 1 THEN (25 * (v // 7 + 2) - 10) * (v // 7 + 2) - 55 ELSE 0 END - CASE WHEN v > 6 THEN 36 ELSE 0 END) // 8)::BIGINT AS codewords
FROM range(1, 41) t(v), (VALUES ('L'), ('M'), ('Q'), ('H')) u(l)""",
)
def q_ec_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tables.dimensions(spark)["qr_ec_block"]
    return groups.groupBy("version", "ec_level").agg(F.sum(F.col("blocks") * (F.col("data_codewords") + F.col("ec_codewords"))).alias("codewords"))


@query("q_roundtrip", "SELECT c_custkey, c_name AS text, 2 AS version, 'M' AS ec_level, 0 AS corrected, NULL::VARCHAR AS error_code FROM customer")
def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode.symbols(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    return codec.decode_matrices(made).select("c_custkey", "text", "version", "ec_level", F.col("ecc.codewords_corrected").alias("corrected"), "error_code")


@query("q_image_roundtrip", "SELECT s_suppkey, s_name AS text, 'text' AS type, 6.0::DOUBLE AS module FROM supplier")
def q_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode.symbols(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", render_scale=6)
    return scan.decode_frames(made.select("s_suppkey", "data", "width", "height")).select("s_suppkey", "text", "content.type", F.round("module_size").alias("module"))


@query("q_part_symbols", "SELECT p_partkey, p_name AS text, NULL::VARCHAR AS error_code FROM part")
def q_part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode.symbols(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "Q")
    return codec.decode_matrices(made).select("p_partkey", "text", "error_code")


@query("q_otsu", """
WITH h AS (SELECT o_orderpriority AS k, (floor(o_totalprice)::BIGINT % 256)::INTEGER AS luma, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
g AS (SELECT k, l::INTEGER AS luma FROM (SELECT DISTINCT k FROM h), range(256) r(l)),
f AS (SELECT g.k, g.luma, coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON h.k = g.k AND h.luma = g.luma),
c AS (SELECT k, luma, sum(n) OVER w AS b, sum(n * luma) OVER w AS m, sum(n) OVER (PARTITION BY k) AS t, sum(n * luma) OVER (PARTITION BY k) AS s FROM f
  WINDOW w AS (PARTITION BY k ORDER BY luma ROWS UNBOUNDED PRECEDING)),
p AS (SELECT k, luma, CASE WHEN b > 0 AND t - b > 0 THEN b * (t - b) * pow(m / b - (s - m) / (t - b), 2) ELSE 0 END AS part FROM c),
q AS (SELECT k, luma, part, max(part) OVER (PARTITION BY k) AS best FROM p)
SELECT k AS o_orderpriority, (((min(luma) + max(luma)) >> 1) + 1)::INTEGER AS threshold FROM q WHERE part = best GROUP BY k""")
def q_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read(spark, sf_dir, "orders").select("o_orderpriority", (F.floor("o_totalprice") % 256).cast("int").alias("luma"))
    return relational.otsu(relational.histogram(pixels, ["o_orderpriority"]), ["o_orderpriority"])


@query("q_rle_profile", """WITH b AS (SELECT l_suppkey AS k, l_quantity > 25 AS bit, row_number() OVER o AS spot, lag(l_quantity > 25) OVER o AS prev FROM lineitem
  WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)),
r AS (SELECT k, bit, spot, sum(CASE WHEN prev IS NOT NULL AND prev <> bit THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT k, run, bool_or(bit) AS bit, count(*)::DOUBLE AS n FROM r GROUP BY k, run),
f AS (SELECT k, run, bit, n AS a, lead(n, 1) OVER o AS b, lead(n, 2) OVER o AS c, lead(n, 3) OVER o AS d, lead(n, 4) OVER o AS e FROM g WINDOW o AS (PARTITION BY k ORDER BY run)),
s AS (SELECT *, a + b + c + d + e AS t FROM f WHERE bit AND e IS NOT NULL)
SELECT k AS l_suppkey, count(*) AS dark_runs, sum((t >= 7 AND (abs(a - t / 7) + abs(b - t / 7) + abs(c - 3 * t / 7) + abs(d - t / 7) + abs(e - t / 7)) / t <= 0.25)::INTEGER)::BIGINT AS finders FROM s GROUP BY k""")
def q_rle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_quantity") > 25).alias("bit"))
    rows = relational.runs(bits, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    from pyspark.sql.window import Window

    whole = rows.withColumn("four", F.lead("length", 4).over(Window.partitionBy("l_suppkey").orderBy("run"))).filter(F.col("bit") & F.col("four").isNotNull()).groupBy("l_suppkey").agg(F.count("*").alias("dark_runs"))
    found = relational.profiles(rows, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("finders"))
    return whole.join(found, "l_suppkey", "left").select("l_suppkey", "dark_runs", F.coalesce("finders", F.lit(0)).alias("finders"))


@query("q_homography", "SELECT c_custkey, round((2 * x + 0.5 * y + 3) / (0.001 * x + 0.002 * y + 1), 6) AS px, round((0.25 * x + 3 * y - 1) / (0.001 * x + 0.002 * y + 1), 6) AS py FROM (SELECT c_custkey, (c_custkey % 177)::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer)")
def q_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.array(*[F.lit(v) for v in (2.0, 0.5, 3.0, 0.25, 3.0, -1.0, 0.001, 0.002, 1.0)])
    p = exprs.homography_point(h, (F.col("c_custkey") % 177).cast("double"), F.col("c_nationkey").cast("double"))
    return read(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("q_versions", "SELECT p_partkey, CASE WHEN s BETWEEN 21 AND 177 AND (s - 17) % 4 = 0 THEN ((s - 17) // 4)::INTEGER END AS version FROM (SELECT p_partkey, p_partkey % 200 AS s FROM part)")
def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", exprs.version_for_size(F.col("p_partkey") % 200).alias("version"))


@query("q_luma", "SELECT l_orderkey, l_linenumber, ((77 * (l_partkey % 256) + 150 * (l_suppkey % 256) + 29 * (l_orderkey % 256)) >> 8) AS luma FROM lineitem")
def q_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", exprs.luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256).alias("luma"))


@query("q_version_bch", "SELECT p_partkey, (7 + p_partkey % 34)::INTEGER AS version, (p_partkey % 4)::INTEGER AS distance FROM part")
def q_version_bch(spark: SparkSession, sf_dir: str) -> DataFrame:
    flips = F.expr("shiftleft(shiftleft(1, cast(p_partkey % 4 as int)) - 1, cast(p_partkey % 15 as int))")
    bits = exprs.version_codeword(7 + F.col("p_partkey") % 34).bitwiseXOR(flips)
    found = read(spark, sf_dir, "part").select("p_partkey", bits.alias("bits")).select("p_partkey", exprs.nearest(F.col("bits"), list(tables.VERSIONS.items())).alias("v"))
    return found.select("p_partkey", F.col("v.data").alias("version"), "v.distance")


@query("q_rs_corrected", "SELECT c_custkey, c_name AS text, (c_custkey % 9)::INTEGER AS corrected FROM customer")
def q_rs_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode.symbols(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    hurt = made.withColumn("matrix", encode.damaged(F.col("matrix"), 2, F.col("c_custkey") % 9))
    return codec.decode_matrices(hurt).select("c_custkey", "text", F.col("ecc.codewords_corrected").alias("corrected"))


@query("q_rs_refused", "SELECT c_custkey, 'reed-solomon' AS error_code FROM customer")
def q_rs_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode.symbols(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    hurt = made.withColumn("matrix", encode.damaged(F.col("matrix"), 2, F.lit(20), most=20))
    return codec.decode_matrices(hurt).select("c_custkey", "error_code")


@query("q_multi", "SELECT n_nationkey, n_name AS text FROM nation UNION ALL SELECT n_nationkey, n_name || ' ' || n_nationkey FROM nation")
def q_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat_ws(" ", "n_name", "n_nationkey").alias("second"))
    made = encode.side_by_side(pairs, "n_name", "second")
    return scan.decode_all_frames(made.select("n_nationkey", "data", "width", "height"), parse_content=False).select("n_nationkey", "text")


@query("q_detect", "SELECT n_nationkey, symbol_seq::INTEGER AS symbol_seq, 6.0::DOUBLE AS module, 4 AS corners FROM nation, range(2) r(symbol_seq)")
def q_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("left "), "n_name").alias("a"), F.concat(F.lit("right "), "n_name").alias("b"))
    found = scan.detect_frames(encode.side_by_side(pairs, "a", "b").select("n_nationkey", "data", "width", "height"))
    return found.select("n_nationkey", "symbol_seq", F.round("module_size").alias("module"), F.size("corner_points").alias("corners"))


@query(
    "q_detection_rate",
    """SELECT ['clean', 'rotated', 'perspective', 'noise', 'gradient', 'low contrast', 'blur 1', 'blur 2', 'inverted'][1 + (s_suppkey % 9)::INTEGER] AS scenario, count(*) AS frames, true AS met
FROM supplier GROUP BY 1""",
)
def q_detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine scenes; met: as many frames are read, with a harder try, as the published floor asks."""
    name, floor = F.array(*[F.lit(x) for x in scenes.SCENES]), F.array(*[F.lit(x[1]) for x in scenes.SCENES.values()])
    kind = (F.col("s_suppkey") % 9 + 1).cast("int")
    shown = scenes.frames(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.element_at(name, kind).alias("scenario"), F.element_at(floor, kind).alias("floor")), "s_name", "scenario", "s_suppkey")
    scanned = scan.scan_frames(shown, try_harder=True)
    hit = F.exists(F.coalesce("results", F.array()), lambda r: r["text"] == F.col("s_name"))
    return scanned.groupBy("scenario").agg(F.count("*").alias("frames"), (F.avg(hit.cast("double")) >= F.first("floor")).alias("met"))


_PIXELS = "SELECT o_orderkey // 256 AS frame, (o_orderkey % 16)::INTEGER AS x, (o_orderkey // 16 % 16)::INTEGER AS y, (floor(o_totalprice)::BIGINT % 256)::INTEGER AS luma FROM orders"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pixels of frames of 16 by 16."""
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 256").alias("frame"), F.expr("cast(o_orderkey % 16 as int)").alias("x"), F.expr("cast(o_orderkey div 16 % 16 as int)").alias("y"), F.expr("cast(floor(o_totalprice) % 256 as int)").alias("luma"))


@query("q_integral", f"WITH p AS ({_PIXELS}) SELECT a.frame, a.x, a.y, sum(b.luma)::BIGINT AS total FROM p a JOIN p b ON a.frame = b.frame AND b.x <= a.x AND b.y <= a.y GROUP BY ALL")
def q_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.integral(pixels(spark, sf_dir), ["frame"]).select("frame", "x", "y", "total")


@query("q_downscale", f"SELECT frame, x // 3 AS x, y // 3 AS y, (sum(luma) // 9)::INTEGER AS luma FROM ({_PIXELS}) WHERE x < 15 AND y < 15 GROUP BY ALL")
def q_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = pixels(spark, sf_dir).withColumns({"width": F.lit(16), "height": F.lit(16)})
    return relational.downscale(sized, ["frame"], 3)


@query(
    "q_triples",
    """WITH p AS (SELECT c_custkey // 10 AS frame, c_custkey AS id, (c_custkey * 37 % 211)::DOUBLE AS x, (c_custkey * 53 % 197)::DOUBLE AS y, (3 + c_custkey % 3)::DOUBLE AS m FROM customer),
t AS (SELECT a.frame, a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy,
    (greatest(a.m, b.m, c.m) - least(a.m, b.m, c.m)) / ((a.m + b.m + c.m) / 3) AS spread, (a.m + b.m + c.m) / 3 AS mean
  FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id JOIN p c ON b.frame = c.frame AND c.id NOT IN (a.id, b.id)),
d AS (SELECT *, sqrt((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)) AS long_, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS u, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS v,
    abs((bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay)) AS dot, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS turn FROM t),
g AS (SELECT *, (u + v) / 2 AS leg FROM d WHERE turn > 0 AND long_ > u AND long_ > v)
SELECT frame, i AS top_left, j AS top_right, k AS bottom_left,
  round(spread + abs(u - v) / leg + 2 * abs(long_ - sqrt(2.0::DOUBLE) * leg) / long_ + dot / (u * v), 6) AS score
FROM g WHERE spread <= 0.5 AND leg / mean BETWEEN 9 AND 185 AND abs(u - v) / leg <= 0.6 AND dot / (u * v) <= 0.5""",
)
def q_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.corner_triples(patterns(spark, sf_dir), ["frame"]).select("frame", "top_left", "top_right", "bottom_left", F.round("score", 6).alias("score"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as finder patterns of frames with ten each."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("frame"), k.alias("pattern_id"), (k * 37 % 211).cast("double").alias("x"), (k * 53 % 197).cast("double").alias("y"), (3 + k % 3).cast("double").alias("module"), F.lit(2).alias("count"))


@query("q_best_triples", f"SELECT frame, min(score) AS score FROM ({ORACLES['q_triples']}) GROUP BY frame")
def q_best_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.best_triples(patterns(spark, sf_dir), ["frame"]).select("frame", F.round("score", 6).alias("score"))


@query(
    "q_distinct_places",
    """WITH RECURSIVE p AS (SELECT o_custkey, o_orderpriority, o_orderkey, (o_orderkey * 7 % 100)::DOUBLE AS x, (o_orderkey * 11 % 90)::DOUBLE AS y, (30 + o_orderkey % 60)::DOUBLE AS d,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderpriority, n, o_orderkey, [{'x': x, 'y': y, 'd': d}] AS kept, true AS new FROM p WHERE n = 1
  UNION ALL SELECT p.o_custkey, p.o_orderpriority, p.n, p.o_orderkey,
    CASE WHEN len(list_filter(f.kept, lambda k: sqrt((k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y)) < greatest(k.d, p.d) / 2)) = 0 THEN list_append(f.kept, {'x': p.x, 'y': p.y, 'd': p.d}) ELSE f.kept END,
    len(list_filter(f.kept, lambda k: sqrt((k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y)) < greatest(k.d, p.d) / 2)) = 0
  FROM f JOIN p ON p.o_custkey = f.o_custkey AND p.o_orderpriority = f.o_orderpriority AND p.n = f.n + 1)
SELECT o_custkey, o_orderpriority, o_orderkey FROM f WHERE new""",
)
def q_distinct_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", (k * 7 % 100).alias("x"), (k * 11 % 90).alias("y"), (30 + k % 60).alias("diagonal"))
    return relational.distinct_places(found, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "q_data_modules",
    """SELECT v::INTEGER AS version, ((16 * v + 128) * v + 64 - CASE WHEN v > 1 THEN (25 * (v // 7 + 2) - 10) * (v // 7 + 2) - 55 ELSE 0 END - CASE WHEN v > 6 THEN 36 ELSE 0 END)::BIGINT AS modules
FROM range(1, 41) t(v)""",
)
def q_data_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dimensions(spark)
    return relational.data_modules(d["qr_version"], d["qr_alignment"])


@query(
    "q_poly_product",
    f"""WITH f AS (SELECT p_partkey AS k, unnest([{{'i': 0, 'c': p_partkey % 256}}, {{'i': 1, 'c': p_size % 256}}, {{'i': 2, 'c': 3}}]) AS s FROM part),
g AS (SELECT p_partkey AS k, unnest([{{'i': 0, 'c': p_size * 5 % 256}}, {{'i': 1, 'c': 7}}]) AS t FROM part),
{_clmul("SELECT f.k, (s.i + t.i)::INTEGER AS power, s.c::BIGINT AS a, t.c::BIGINT AS b FROM f JOIN g ON f.k = g.k", "k, power, ")}
SELECT k AS p_partkey, power, bit_xor(p)::INTEGER AS coefficient FROM p7 GROUP BY ALL""",
)
def q_poly_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    terms = lambda *cs: part.select("p_partkey", F.posexplode(F.array(*[c.cast("int") for c in cs])).alias("power", "coefficient"))
    return relational.poly_product(terms(F.col("p_partkey") % 256, F.col("p_size") % 256, F.lit(3)), terms(F.col("p_size") * 5 % 256, F.lit(7)), ["p_partkey"])


@query(
    "q_regions",
    """SELECT p_partkey, l AS x, t AS y, greatest(1, least(50, 120 - l))::INTEGER AS width, greatest(1, least(p_size, 100 - t))::INTEGER AS height
FROM (SELECT *, greatest(0, least(p_partkey % 300 - 90, 119))::INTEGER AS l, greatest(0, least(floor(p_retailprice)::BIGINT % 150 - 20, 99))::INTEGER AS t FROM part)""",
)
def q_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = exprs.clamped_region(F.col("p_partkey") % 300 - 90 + F.lit(0.5), F.floor("p_retailprice") % 150 - 20, F.lit(50.75), F.col("p_size"), F.lit(120), F.lit(100))
    return read(spark, sf_dir, "part").select("p_partkey", area.alias("r")).select("p_partkey", "r.*")


@query("q_scales", "SELECT p_partkey, CASE WHEN greatest(w, h) > 2000 THEN '4,1,2' WHEN greatest(w, h) > 1000 THEN '2,1' WHEN least(w, h) >= 42 THEN '1,2' ELSE '1' END AS passes FROM (SELECT p_partkey, p_partkey * 7 % 3000 + 200 AS w, p_size * 30 + 20 AS h FROM part)")
def q_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = exprs.scales((F.col("p_partkey") * 7 % 3000 + 200).cast("int"), F.col("p_size") * 30 + 20, try_harder=True, max_downscale=4)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(plan, lambda k: k.cast("string")), ",").alias("passes"))


@query("q_external", "SELECT c_custkey, c_name AS text, 0 AS version, 'M' AS ec_level, -1 AS mask, (c_nationkey + 25) / 25 AS module FROM customer WHERE c_custkey % 4 > 0")
def q_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = (F.col("c_nationkey") + 25).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = F.lit(0.0)
    corners = F.slice(F.array(point(o, o), point(side, o), point(side, side), point(o, side)), F.lit(1), F.when(F.col("c_custkey") % 4 == 0, 3).otherwise(4))
    found = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("frame_id"), F.lit(0).alias("seq"), F.col("c_name").alias("text"), corners.alias("corner_points"))
    return frames.external_results(found).select("c_custkey", "text", "version", "ec_level", "mask", F.col("module_size").alias("module"))


@query(
    "q_content_fields",
    """SELECT s_suppkey, ['sms', 'email', 'email', 'geo', 'wifi', 'vcard', 'text'][s_suppkey % 7 + 1] AS type,
  CASE s_suppkey % 7 WHEN 0 THEN 'a+b ' || s_suppkey WHEN 1 THEN 'x y' WHEN 2 THEN 'hello' WHEN 4 THEN 'nopass' WHEN 5 THEN 'Org ' || s_suppkey WHEN 6 THEN 'tel: +' || s_suppkey || chr(10) || 'x' END AS one,
  CASE s_suppkey % 7 WHEN 1 THEN s_name || '@example.org' WHEN 2 THEN s_name WHEN 5 THEN s_name END AS two, CASE s_suppkey % 7 WHEN 3 THEN s_suppkey + 0.5 END::DOUBLE AS altitude FROM supplier""",
)
def q_content_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.expr("""CASE s_suppkey % 7 WHEN 0 THEN concat('sms:+1', s_suppkey, '?body=a+b%20', s_suppkey) WHEN 1 THEN concat('MAILTO:', replace(s_name, '#', '%23'), '@example.org?subject=x+y')
      WHEN 2 THEN concat('MATMSG:TO:', s_name, ';BODY:hello;;') WHEN 3 THEN concat('geo:1.5,-2,', s_suppkey, '.5;u=3') WHEN 4 THEN concat('wifi:S:', s_name, ';T:nopass;P:secret;;')
      WHEN 5 THEN concat('BEGIN:VCARD\\r\\nFN;X=1: ', s_name, ' \\r\\nORG:Org ', s_suppkey, '\\r\\nEND:VCARD') ELSE concat('tel: +', s_suppkey, '\\nx') END""")
    c = read(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("p")).select("s_suppkey", parse_content(F.col("p")).alias("c"))
    one = F.coalesce("c.message", "c.subject", "c.body", "c.security", "c.org", "c.text")
    return c.select("s_suppkey", "c.type", one.alias("one"), F.coalesce("c.email_to", "c.name", "c.password").alias("two"), "c.altitude")


#: Payloads of many segments: (segments in SQL, what a reader gives for the text in SQL for DuckDB, modes, further).
_CASES = [
    ("array(seg('numeric', lpad(c_custkey, 9, '0')))", "lpad(c_custkey::VARCHAR, 9, '0')", "numeric", ""),
    ("array(seg('alphanumeric', concat('AC-', c_custkey, ' $%')))", "'AC-' || c_custkey || ' $%'", "alphanumeric", ""),
    ("array(seg('byte', concat('é ', c_name)))", "'é ' || c_name", "byte", ""),
    ("array(seg('kanji', '点茗漾'), seg('numeric', '7'))", "'点茗漾7'", "kanji,numeric", ""),
    ("array(num('eci', 9), raw('E1E2'))", "'αβ'", "eci,byte", "9"),
    ("array(num('eci', 3), raw('809981'))", "'€™' || chr(129)", "eci,byte", "3"),
    ("array(num('fnc1', 0), seg('alphanumeric', 'A%%B%C'))", "'A%B' || chr(29) || 'C'", "alphanumeric", "first"),
    ("array(num('fnc1-second', 165), seg('numeric', '12'), seg('alphanumeric', 'X%Y'))", "'12X' || chr(29) || 'Y'", "numeric,alphanumeric", "second A"),
    ("array(num('fnc1-second', 7), seg('byte', 'a%'))", "'a%'", "byte", "second 07"),
    ("array(num('append', 1, 3, 77), seg('byte', 'part'))", "'part'", "byte", "1 of 3, 77"),
    ("array(num('eci', 25), raw('FEFF00410042'))", "'AB'", "eci,byte", "25"),
    ("array(raw('EFBBBF41'))", "'A'", "byte", ""),
    ("array(raw('FF9941'))", "'ÿ™A'", "byte", ""),
    ("array(num('eci', 2), raw('C3A9'))", "'é'", "eci,byte", "2"),
    ("array(num('eci', 170), raw('80'), num('eci', 26), raw('E282AC'))", "'€€'", "eci,byte,eci,byte", "170 26"),
    ("array(num('eci', 20000), raw('C3A9'))", "'é'", "eci,byte", "20000"),
    ("array(seg('raw', '0110'))", "NULL", "NULL", "bitstream"),
    ("array(seg('raw', '0001000000000111111111110000'))", "NULL", "NULL", "bitstream"),
]


def _segments_sql(text: str) -> str:
    """Spark SQL of a case: seg(mode, text), num(mode, a, b, c) and raw(hex) are structs of a segment."""
    import re

    struct = "named_struct('mode', {}, 'text', {}, 'bytes', {}, 'a', {}, 'b', {}, 'c', {})"
    text = re.sub(r"num\('([^']+)', (\d+)(?:, (\d+), (\d+))?\)", lambda m: struct.format(f"'{m[1]}'", "cast(null as string)", "cast(null as binary)", m[2], m[3] or 0, m[4] or 0), text)
    text = re.sub(r"raw\('([^']+)'\)", lambda m: struct.format("'byte'", "cast(null as string)", f"X'{m[1]}'", 0, 0, 0), text)
    return re.sub(r"seg\('([^']+)', (concat\([^()]*\)|lpad\([^()]*\)|'[^']*')\)", lambda m: struct.format(f"'{m[1]}'", m[2], "cast(null as binary)", 0, 0, 0), text)


def _case(values: list[str]) -> str:
    return f"CASE c_custkey % {len(_CASES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_quoted = lambda v: "NULL" if v == "NULL" else f"'{v}'"


@query(
    "q_segments",
    f"""SELECT c_custkey, CASE WHEN error_code IS NULL THEN [2, 9, 12, 28][1 + (c_custkey % 4)::INTEGER] END::INTEGER AS version, hex(text) AS text, modes,
  CASE WHEN error_code IS NULL THEN further END AS further, error_code
FROM (SELECT c_custkey, {_case([c[1] for c in _CASES])} AS text, {_case([_quoted(c[2]) for c in _CASES])} AS modes, {_case([_quoted(c[3]) for c in _CASES])} AS further,
  CASE WHEN c_custkey % {len(_CASES)} >= {len(_CASES) - 2} THEN 'bitstream' END AS error_code FROM customer)""",
)
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode, character set and header at versions of all three count widths."""
    made = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_case([_segments_sql(c[0]) for c in _CASES])).alias("segments_in"), F.element_at(F.array(*[F.lit(v) for v in (2, 9, 12, 28)]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("version_in"))
    got = codec.decode_matrices(encode.segment_symbols(made, "segments_in", "version_in"))
    assigned = F.array_join(F.transform(F.filter("segments", lambda s: s["mode"] == "eci"), lambda s: s["assignment"].cast("string")), " ")
    append = F.concat(F.col("structured_append.index"), F.lit(" of "), F.col("structured_append.total"), F.lit(", "), F.col("structured_append.parity"))
    fnc1 = F.concat_ws(" ", "fnc1.position", "fnc1.application_indicator")
    further = F.when(F.col("error_code").isNull(), F.coalesce(append, F.when(F.col("fnc1").isNotNull(), fnc1), assigned))
    return got.select("c_custkey", "version", F.hex("text").alias("text"), F.array_join(F.transform("segments", lambda s: s["mode"]), ",").alias("modes"), further.alias("further"), "error_code")


@query("q_large_symbols", "SELECT s_suppkey, s_name AS text, 7 + (s_suppkey % 4)::INTEGER AS version, NULL::VARCHAR AS error_code FROM supplier")
def q_large_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of symbols that declare their version."""
    made = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (7 + F.col("s_suppkey") % 4).cast("int").alias("v"), F.array(F.struct(F.lit("byte").alias("mode"), F.col("s_name").alias("text"), F.lit(None).cast("binary").alias("bytes"), *[F.lit(0).alias(c) for c in "abc"])).alias("parts"))
    shown = encode.rendered(encode.segment_symbols(made, "parts", "v"), 4)
    scanned = scan.scan_frames(shown.select("s_suppkey", "data", "width", "height"))
    return scanned.select("s_suppkey", F.col("results")[0]["text"].alias("text"), F.col("results")[0]["version"].alias("version"), "error_code")


@query(
    "q_joined_metadata",
    """SELECT c_custkey, 'a' || c_custkey || 'b' || c_custkey AS text, 3 AS ecc_blocks, 3::BIGINT AS corrected, '[{"m":"x"},{"m":1},{"m":2}]' AS segments, 1 AS mask FROM customer""",
)
def q_joined_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two parts: text, counts and segments of both, the rest of the last."""
    both = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(0))).alias("index"))
    whole = F.concat(F.lit("a"), F.col("c_custkey"), F.lit("b"), F.col("c_custkey")).cast("binary")
    text = F.concat(F.when(F.col("index") == 0, "a").otherwise("b"), F.col("c_custkey"))
    parts = both.select("c_custkey", "index", F.timestamp_millis(F.lit(1000) - F.col("index")).alias("ts"), F.lit(2).alias("total"), scanner.xor_bytes(whole).alias("parity"), text.alias("text"), text.cast("binary").alias("bytes"), (F.col("index") + 1).alias("ecc_blocks"), (2 - F.col("index")).cast("bigint").alias("corrected"),
                        F.when(F.col("index") == 0, '[{"m":"x"}]').otherwise('[{"m":1},{"m":2}]').alias("segments"), F.col("index").alias("mask"))
    joined = scanner.reassemble(parts, ["c_custkey"], sums=["ecc_blocks", "corrected"], lists=["segments"], last=["mask"])
    return joined.select("c_custkey", "text", "ecc_blocks", "corrected", "segments", "mask")


@query(
    "q_field",
    f"""WITH {_clmul("SELECT l_orderkey, l_linenumber, l_partkey % 256 AS k0, l_suppkey % 255 + 1 AS a, l_orderkey % 256 AS b FROM lineitem", "l_orderkey, l_linenumber, k0, ")}
SELECT l_orderkey, l_linenumber, b::INTEGER AS quotient, 1 AS one, xor(k0, p)::INTEGER AS value FROM p7""",
)
def q_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b from (a * b) / a, a times its inverse, and the value of k0 + a x at b."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("k0"), (F.col("l_suppkey") % 255 + 1).cast("int").alias("a"), (F.col("l_orderkey") % 256).cast("int").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("l_orderkey", "l_linenumber", exprs.gf_div(exprs.gf_mul(a, b), a).alias("quotient"), exprs.gf_mul(a, exprs.gf_inv(a)).alias("one"), exprs.poly_eval(F.array("k0", "a"), b).alias("value"))


@query(
    "q_points",
    """SELECT p_partkey, round(x * 2, 6) AS scaled_x, round(y * 2, 6) AS scaled_y, round(x + 7, 6) AS moved_x, round(y - 3, 6) AS moved_y,
  round(x * k + (300 - 640 * k) / 2, 6) AS shown_x, round(y * k + (200 - p_size * 10 * k) / 2, 6) AS shown_y
FROM (SELECT p_partkey, p_size, (p_partkey % 640)::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, CASE WHEN p_partkey % 2 = 0 THEN least(300 / 640.0::DOUBLE, 200 / (p_size * 10.0::DOUBLE)) ELSE greatest(300 / 640.0::DOUBLE, 200 / (p_size * 10.0::DOUBLE)) END AS k FROM part)""",
)
def q_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.array(F.struct((F.col("p_partkey") % 640).cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y")))
    fit = F.when(F.col("p_partkey") % 2 == 0, "contain").otherwise("cover")
    shown = exprs.element_points(point, fit, (F.lit(640.0), F.col("p_size") * 10.0), (F.lit(300.0), F.lit(200.0)))
    rows = read(spark, sf_dir, "part").select("p_partkey", exprs.scaled(point, 2.0).alias("scaled"), exprs.shifted(point, F.lit(7.0), F.lit(-3.0)).alias("moved"), shown.alias("shown"))
    return rows.select("p_partkey", *[F.round(F.col(c)[0][axis], 6).alias(f"{c}_{axis}") for c in ("scaled", "moved", "shown") for axis in "xy"])


@query(
    "q_window_means",
    f"""WITH p AS ({_PIXELS}), f AS (SELECT frame FROM p GROUP BY frame HAVING count(*) = 256), t AS (SELECT frame, i::INTEGER AS tx, j::INTEGER AS ty FROM f, range(4) a(i), range(4) b(j))
SELECT t.frame, tx, ty, round(avg(luma), 6) AS mean FROM t JOIN p ON p.frame = t.frame AND abs(p.x - tx * 4 - 2) <= 3 AND abs(p.y - ty * 4 - 2) <= 3 GROUP BY ALL""",
)
def q_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pixels(spark, sf_dir)
    whole = cells.join(cells.groupBy("frame").agg(F.count("*").alias("n")).filter("n = 256").select("frame"), "frame")
    return relational.window_means(whole, ["frame"], 16, 16, 4, 3).select("frame", "tx", "ty", F.round("mean", 6).alias("mean"))
