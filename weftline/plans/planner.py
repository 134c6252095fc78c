"""Planning: requests joined to the ordered route table, first route whose requirements hold wins.

Everything is one DataFrame pipeline without a shuffle of requests: a broadcast join with the ordered
routes of each (source, target), a requirement test per route, the first of those that hold, and a
CASE that explains a refusal.
Guards come before the table: polyglots, unknown inputs, then routes, then the class ceiling. A
request always comes back with steps or with a reason, never with neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.detect import _sql_format, text_format
from weftline.plans import catalog
from weftline.session import table

#: Formats that hold streams; the carry tests apply to these containers.
REQUEST = "req_id long, source string, target string, polyglot boolean, video string, audio string, ceiling string"


def holds(requirement: Column, engines: Column, carries: Column, target: Column, video: Column, audio: Column) -> Column:
    """One requirement. A missing video or audio stream passes StreamsCompatible; AudioCompatible needs audio."""
    can = lambda kind, codec: F.array_contains(carries, F.concat_ws("/", target, F.lit(kind), codec))
    streams = F.when(video.isNull(), True).otherwise(can("video", video)) & F.when(audio.isNull(), True).otherwise(can("audio", audio))
    sound = F.when(audio.isNull(), False).otherwise(can("audio", audio))
    return F.when(requirement == "StreamsCompatible", streams).when(requirement == "AudioCompatible", sound).otherwise(F.array_contains(engines, requirement))


def plan(requests: DataFrame, available: dict[str, bool] | None = None) -> DataFrame:
    """``requests`` as in REQUEST to ``req_id, source, target, class, steps, reason``."""
    spark = requests.sparkSession
    ready = [e for e, ok in (available or catalog.ENGINES).items() if ok]
    engines = F.array(*[F.lit(e) for e in ready]) if ready else F.array().cast("array<string>")
    carries = F.array(*[F.lit(f"{c}/{k}/{x}") for k, t in (("video", catalog.VIDEO_CARRY), ("audio", catalog.AUDIO_CARRY)) for c, xs in t.items() for x in xs])
    option = F.struct("ord", "class", "requires", F.array_append(F.col("via"), F.col("target")).alias("steps"))
    routes = catalog.routes(spark).groupBy("source", "target").agg(F.array_sort(F.collect_list(option)).alias("options"))  # a row a pair, at most 2,450
    joined = requests.join(F.broadcast(routes), ["source", "target"], "left")
    unmet = lambda o: F.filter(o["requires"], lambda r: ~holds(r, engines, carries, F.col("target"), F.col("video"), F.col("audio")))
    tested = joined.withColumn("tested", F.transform("options", lambda o: F.struct(o["class"].alias("class"), o["steps"].alias("steps"), F.try_element_at(unmet(o), F.lit(1)).alias("unmet"))))
    picked = tested.select(
        "req_id", "source", "target", "polyglot", "ceiling", F.try_element_at(F.filter("tested", lambda o: o["unmet"].isNull()), F.lit(1)).alias("route"),
        F.try_element_at("tested", F.lit(1))["unmet"].alias("unmet"), F.coalesce(F.size("tested"), F.lit(0)).alias("candidates"),
    )
    kinds = catalog.formats(spark).select("id", "kind")
    known = picked.join(F.broadcast(kinds.select(F.col("id").alias("source"), F.col("kind").alias("source_kind"))), "source", "left").join(F.broadcast(kinds.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))), "target", "left")
    reason = (
        F.when(F.col("polyglot"), "Polyglot")
        .when(F.col("source") == "Unknown", "UnknownInput")
        .when(F.col("route").isNotNull(), F.when(F.col("route.class") > F.col("ceiling"), F.concat(F.lit("ClassCeiling:"), F.col("route.class"))))
        .when(F.col("candidates") > 0, F.concat(F.lit("RequirementUnmet:"), F.col("unmet")))
        .when(F.col("source_kind") != F.col("target_kind"), "CrossKind")
        .otherwise("UnsupportedPair")
    )
    done = known.withColumn("reason", reason)
    return done.select("req_id", "source", "target", F.when(F.col("reason").isNull(), F.col("route.class")).alias("class"), F.when(F.col("reason").isNull(), F.array_join("route.steps", ">")).alias("steps"), "reason")


#: Warnings that leave a plan without steps.
BLOCKING = ("Polyglot", "AboveAutoClass", "NoRoute")


def warned(plans: DataFrame, declared: Column | None = None) -> DataFrame:
    """Plans with ``warnings``, ``blocked`` and ``executable``; ``declared`` is the format that the name claims.

    A claim that the bytes deny and a loss of quality warn only; the others come with no steps.
    """
    mismatch = F.when(declared.isNotNull() & (declared != F.col("source")), "TypeMismatch") if declared is not None else F.lit(None).cast("string")
    refusal = F.when(F.col("reason") == "Polyglot", "Polyglot").when(F.startswith("reason", F.lit("ClassCeiling")), "AboveAutoClass").when(F.col("reason").isNotNull(), "NoRoute")
    loss = F.when(F.col("reason").isNull() & (F.col("class") > "A"), F.concat(F.lit("Lossy:"), F.col("class")))
    found = plans.withColumn("warnings", F.array_compact(F.array(mismatch, refusal, loss)))
    blocked = F.exists("warnings", lambda w: w.isin(*BLOCKING))
    return found.withColumn("blocked", blocked).withColumn("executable", ~F.col("blocked") & F.col("steps").isNotNull())


def needs_worker(source: Column, source_kind: Column, target: Column, target_kind: Column) -> Column:
    """Whether a conversion must leave the process: text, documents, drawings, decoded media and AVIF."""
    documents = ((source_kind == "document") | (target_kind == "document")) & (source_kind != "image")
    decoded = (source_kind == "video") & ((target_kind == "video") | ((target_kind == "audio") & (target != "Mka")))
    return (target == "Txt") | documents | (source == "Svg") | decoded | (target == "Avif")


#: Class that a named target arms by itself: text from media is generative, other formats are rebuilt.
def armed_class(target: Column) -> Column:
    return F.when(target == "Txt", "D").otherwise("C")


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.array(*[F.lit(t) for t in ("Markdown", "Txt", "Pdf", "Csv", "Mp4")])
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("req_id"), text_format(F.col("html")).alias("source"))
    return pages.withColumn("target", F.element_at(targets, (F.pmod("req_id", F.lit(5)) + 1).cast("int"))).selectExpr("req_id", "source", "target", "false AS polyglot", "CAST(NULL AS STRING) AS video", "CAST(NULL AS STRING) AS audio", "'C' AS ceiling")


def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every page: detected format, a target by turns, first matching route or a reason."""
    return plan(_page_requests(spark, sf_dir))


# Requests of the queries: what a stream of events asks for. Codecs by kind of event and by user.
_VIDEO = {"click": "h264", "view": "vp9", "signup": "av1", "error": "h265"}
_AUDIO = ("aac", "opus", None, "mp3")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for one conversion; neighbouring events walk through all pairs of formats."""
    ids = F.array(*[F.lit(r[1]) for r in catalog.format_rows()])
    named = lambda at: F.element_at(ids, (at % len(catalog.format_rows()) + 1).cast("int"))
    video = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _VIDEO.items()])
    audio = F.element_at(F.array(*map(F.lit, _AUDIO)), (F.col("user_id") % len(_AUDIO) + 1).cast("int"))
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), named(F.col("event_id")).alias("source"), named(F.floor(F.col("event_id") / 50)).alias("target"), F.lit(False).alias("polyglot"), video.alias("video"), audio.alias("audio"))
    return found.where("source <> target")


def _planned(spark: SparkSession, sf_dir: str, ceiling: str, available: dict[str, bool] | None = None) -> DataFrame:
    return plan(_requests(spark, sf_dir).withColumn("ceiling", F.lit(ceiling)), available)


_EVERY = dict.fromkeys(catalog.ENGINES, True)


def plan_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every request, no class ceiling, all engines available."""
    return _planned(spark, sf_dir, "D", _EVERY)


def plan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why requests are refused with the engines of this library: requests by reason."""
    return _planned(spark, sf_dir, "D").groupBy("reason").agg(F.count("*").alias("requests"))


def plan_class_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the default ceiling B refuses although a route holds."""
    return _planned(spark, sf_dir, "B", _EVERY).where(F.startswith("reason", F.lit("ClassCeiling"))).select("req_id", "source", "target", "reason")


def codec_carry_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests bring a codec to a container that can carry it."""
    q = _requests(spark, sf_dir)
    streams = q.select(F.col("target").alias("container"), F.expr("stack(2, 'video', video, 'audio', audio) AS (stream, codec)"))
    return streams.join(F.broadcast(catalog.codec_carry(spark)), ["container", "stream", "codec"]).groupBy("container", "stream", "codec").agg(F.count("*").alias("requests"))


def enumerate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable targets asked of each format, by the engines of this library, and the worst class among them."""
    ready = _planned(spark, sf_dir, "D").where("reason IS NULL")
    return ready.groupBy("source").agg(F.count_distinct("target").alias("targets"), F.max("class").alias("worst_class"))


def plan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of every request under ceiling B, where the name claims a picture by turns."""
    claimed = F.when(F.pmod("req_id", F.lit(4)) == 0, F.lit("Png"))
    found = warned(_planned(spark, sf_dir, "B", _EVERY), claimed)
    return found.select("req_id", F.array_join("warnings", ",").alias("warnings"), "blocked", "executable")


def worker_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned requests by class and by whether they need a worker."""
    kinds = catalog.formats(spark).select("id", "kind")
    ends = _planned(spark, sf_dir, "D", _EVERY).where("reason IS NULL").join(F.broadcast(kinds.selectExpr("id AS source", "kind AS source_kind")), "source").join(F.broadcast(kinds.selectExpr("id AS target", "kind AS target_kind")), "target")
    return ends.select("class", needs_worker(*map(F.col, ("source", "source_kind", "target", "target_kind"))).alias("worker")).groupBy("class", "worker").agg(F.count("*").alias("requests"))


def route_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned requests by class, with the pairs of formats among them and the class that their target arms."""
    found = _planned(spark, sf_dir, "D", _EVERY).where("reason IS NULL")
    return found.groupBy("class", armed_class(F.col("target")).alias("armed")).agg(F.count("*").alias("requests"), F.count_distinct("source", "target").alias("pairs"))


def _plan_sql(requests: str, available: list[str], ceiling: str) -> str:
    carry = [(c, k, x) for k, t in (("video", catalog.VIDEO_CARRY), ("audio", catalog.AUDIO_CARRY)) for c, xs in t.items() for x in xs]
    ready = "[" + ", ".join(f"'{e}'" for e in available) + "]::VARCHAR[]"
    return f"""
WITH formats AS (SELECT * FROM {catalog.sql_values([(r[0], r[1], r[2]) for r in catalog.format_rows()], 'i, id, kind')}),
routes AS (SELECT * FROM {catalog.sql_values(catalog.route_rows(), 'ord, source, target, class, requires, via')}),
carry AS (SELECT * FROM {catalog.sql_values(carry, 'container, stream, codec')}),
requests AS ({requests}),
tested AS (
  SELECT q.*, r.ord, r.class, r.via, list_filter(r.requires, lambda x: NOT CASE
      WHEN x = 'StreamsCompatible' THEN (q.video IS NULL OR v.codec IS NOT NULL) AND (q.audio IS NULL OR a.codec IS NOT NULL)
      WHEN x = 'AudioCompatible' THEN q.audio IS NOT NULL AND a.codec IS NOT NULL ELSE list_contains({ready}, x) END) AS failed
  FROM requests q LEFT JOIN routes r ON q.source = r.source AND q.target = r.target
  LEFT JOIN carry v ON v.container = q.target AND v.stream = 'video' AND v.codec = q.video
  LEFT JOIN carry a ON a.container = q.target AND a.stream = 'audio' AND a.codec = q.audio
), best AS (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY (ord IS NULL OR len(failed) > 0), ord) AS rn FROM tested
), reasoned AS (
  SELECT b.*, CASE WHEN b.source = 'Unknown' THEN 'UnknownInput' WHEN ord IS NOT NULL AND len(failed) = 0 THEN CASE WHEN class > '{ceiling}' THEN 'ClassCeiling:' || class END
    WHEN ord IS NOT NULL THEN 'RequirementUnmet:' || failed[1] WHEN f.kind <> g.kind THEN 'CrossKind' ELSE 'UnsupportedPair' END AS reason
  FROM best b LEFT JOIN formats f ON f.id = b.source LEFT JOIN formats g ON g.id = b.target WHERE rn = 1
), planned AS (
  SELECT req_id, source, target, CASE WHEN reason IS NULL THEN class END AS class, CASE WHEN reason IS NULL THEN array_to_string(list_append(via, target), '>') END AS steps, reason FROM reasoned
)
"""


_EVENTS_SQL = f"""SELECT event_id AS req_id, s.id AS source, t.id AS target, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VIDEO.items())} END AS video,
  ['aac', 'opus', NULL, 'mp3'][user_id % 4 + 1] AS audio FROM events JOIN formats s ON s.i = event_id % 50 JOIN formats t ON t.i = event_id // 50 % 50 WHERE s.i <> t.i"""
_PAGES_SQL = f"SELECT page_id AS req_id, {_sql_format('html')} AS source, ['Markdown', 'Txt', 'Pdf', 'Csv', 'Mp4'][page_id % 5 + 1] AS target, NULL::VARCHAR AS video, NULL::VARCHAR AS audio FROM pages"
_ALL, _OWN = list(catalog.ENGINES), [e for e, ok in catalog.ENGINES.items() if ok]

QUERIES = {"plan_pages": plan_pages, "plan_first_match": plan_first_match, "plan_refusals": plan_refusals, "plan_class_ceiling": plan_class_ceiling, "codec_carry_matrix": codec_carry_matrix, "enumerate_targets": enumerate_targets, "route_classes": route_classes, "plan_warnings": plan_warnings, "worker_needs": worker_needs}
ORACLES = {
    "plan_pages": _plan_sql(_PAGES_SQL, _OWN, "C") + "SELECT * FROM planned",
    "plan_first_match": _plan_sql(_EVENTS_SQL, _ALL, "D") + "SELECT * FROM planned",
    "plan_refusals": _plan_sql(_EVENTS_SQL, _OWN, "D") + "SELECT reason, count(*) AS requests FROM planned GROUP BY reason",
    "plan_class_ceiling": _plan_sql(_EVENTS_SQL, _ALL, "B") + "SELECT req_id, source, target, reason FROM planned WHERE reason LIKE 'ClassCeiling%'",
    "plan_warnings": _plan_sql(_EVENTS_SQL, _ALL, "B") + """, w AS (SELECT req_id, steps, reason, class, CASE WHEN req_id % 4 = 0 AND source <> 'Png' THEN 'TypeMismatch' END AS m FROM planned)
SELECT req_id, concat_ws(',', m, CASE WHEN reason LIKE 'ClassCeiling%' THEN 'AboveAutoClass' WHEN reason IS NOT NULL THEN 'NoRoute' WHEN class > 'A' THEN 'Lossy:' || class END) AS warnings,
  reason IS NOT NULL AS blocked, reason IS NULL AS executable FROM w""",
    "worker_needs": _plan_sql(_EVENTS_SQL, _ALL, "D") + """SELECT class, target = 'Txt' OR target = 'Avif' OR source = 'Svg' OR (s.kind <> 'image' AND 'document' IN (s.kind, t.kind)) OR (s.kind = 'video' AND (t.kind = 'video' OR (t.kind = 'audio' AND target <> 'Mka'))) AS worker, count(*) AS requests
FROM planned JOIN formats s ON s.id = source JOIN formats t ON t.id = target WHERE reason IS NULL GROUP BY 1, 2""",
    "codec_carry_matrix": _plan_sql(_EVENTS_SQL, _ALL, "D") + "SELECT container, stream, codec, count(*) AS requests FROM carry JOIN requests q ON q.target = container AND codec = CASE stream WHEN 'video' THEN q.video ELSE q.audio END GROUP BY 1, 2, 3",
    "enumerate_targets": _plan_sql(_EVENTS_SQL, _OWN, "D") + "SELECT source, count(DISTINCT target) AS targets, max(class) AS worst_class FROM planned WHERE reason IS NULL GROUP BY source",
    "route_classes": _plan_sql(_EVENTS_SQL, _ALL, "D") + "SELECT class, CASE WHEN target = 'Txt' THEN 'D' ELSE 'C' END AS armed, count(*) AS requests, count(DISTINCT source || '>' || target) AS pairs FROM planned WHERE reason IS NULL GROUP BY 1, 2",
}
