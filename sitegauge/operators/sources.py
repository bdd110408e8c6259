"""Reading fetched material: responses, robots, sitemaps, ads.txt, traffic, third-party results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitegauge.functions import text as tx, url as ux
from sitegauge.operators.numbering import first_per_group
from sitegauge.params import DEFAULT, Params

C = F.col


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Fetched responses: url, status, headers map<string,array<string>>, html."""
    return spark.read.parquet(path)


def header(headers: Column, name: str) -> Column:
    """First value of a header, name compared without case; empty when absent."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(F.get(found, F.lit(0))["value"], F.lit(0)), F.lit(""))


def response_state(responses: DataFrame) -> DataFrame:
    """Marks each response as accepted, failed or non_html."""
    kind = F.lower(header(C("headers"), "content-type"))
    state = (
        F.when(C("status") >= 400, "failed").when((kind != "") & ~kind.contains("html"), "non_html").otherwise("accepted")
    )
    return responses.withColumn("response_state", state)


def src_responses(responses: DataFrame) -> DataFrame:
    return response_state(responses).filter("response_state = 'accepted'").drop("response_state")


def response_counters(responses: DataFrame) -> DataFrame:
    return response_state(responses).agg(
        F.count_if(C("response_state") == "accepted").alias("accepted"),
        F.count_if(C("response_state") == "failed").alias("failed_requests"),
        F.count_if(C("response_state") == "non_html").alias("non_html_responses"),
    )


def dedupe_final_url(responses: DataFrame) -> DataFrame:
    """First response per normalised final URL. Winners are picked without the bodies, then joined to them."""
    keyed = responses.withColumn("url_hash", ux.url_hash(ux.normalize(C("url"))))
    winners = keyed.groupBy("url_hash").agg(F.min("position").alias("position"))
    return keyed.join(winners, ["url_hash", "position"])


def response_limit(responses: DataFrame, body: str = "html", limit: int = DEFAULT.max_body_bytes) -> DataFrame:
    """Adds ``bytes`` and ``oversized``: a body over the limit is marked and stays, so that no page is lost in silence."""
    return responses.withColumn("bytes", F.octet_length(body)).withColumn("oversized", C("bytes") > limit)


def src_robots(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Policy text per site origin; a missing or failed file is an empty policy."""
    ok = robots.filter(C("status") < 400).select("origin", C("text").alias("robots_text"))
    return sites.join(ok, "origin", "left").withColumn("robots_text", F.coalesce("robots_text", F.lit("")))


def src_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Usable sitemap bodies."""
    return sitemaps.filter((C("status") < 400) & (tx.trim(C("body")) != ""))


def ads_txt_lines(ads: DataFrame) -> DataFrame:
    """Non-blank, non-comment lines of ads.txt per origin."""
    lines = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), tx.trim), lambda l: (l != "") & ~l.startswith("#")
    )
    return ads.select("origin", F.posexplode(lines).alias("line", "entry"))


def page_views(views: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """Views of every path over the last full days; a report may ask for its highest ``traffic_rows`` rows only."""
    day = F.date_trunc("day", now)
    recent = views.filter((C("ts") >= F.timestamp_add("DAY", F.lit(-p.traffic_days), day)) & (C("ts") < day))
    counts = recent.groupBy("path").agg(F.count("*").alias("views"))
    return counts.orderBy(F.desc("views"), "path").limit(p.traffic_rows) if p.traffic_rows else counts


MODERATION_SCHEMA = "status string, request struct<id string>, moderation_classes map<string,string>"


def src_moderation(raw: DataFrame) -> DataFrame:
    """Stored moderation replies (url, payload) as status, request id and numeric class scores."""
    r = F.from_json("payload", MODERATION_SCHEMA)
    scores = F.map_filter(
        F.transform_values(F.coalesce(C("r.moderation_classes"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), lambda k, x: x.try_cast("double")),
        lambda k, x: x.isNotNull(),
    )
    return raw.withColumn("r", r).select("url", C("r.status").alias("status"), C("r.request.id").alias("request_id"), scores.alias("classes"))


def src_llm_responses(raw: DataFrame) -> DataFrame:
    """Stored model replies (url, payload) of the four envelope shapes as reply text, response id and token counts."""
    g = lambda path: F.get_json_object("payload", path)
    output = F.from_json(g("$.output"), "array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    messages = F.filter(F.coalesce(output, F.array().cast(
        "array<struct<type:string,content:array<struct<type:string,text:string>>>>")), lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda o: F.filter(
        o["content"], lambda x: (x["type"] == "output_text") & x["text"].isNotNull())))
    reply = F.coalesce(
        F.get(parts, F.lit(0))["text"], g("$.candidates[0].content.parts[0].text"), g("$.message.content"), g("$.choices[0].message.content")
    )
    tokens = lambda *paths: F.coalesce(*[g(x).try_cast("long") for x in paths], F.lit(0))
    return raw.select(
        *[c for c in raw.columns if c != "payload"], reply.alias("reply"),
        F.coalesce(g("$.responseId"), g("$.id")).alias("response_id"),
        tokens("$.usage.input_tokens", "$.usageMetadata.promptTokenCount", "$.prompt_eval_count", "$.usage.prompt_tokens").alias("input_tokens"),
        tokens("$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount", "$.eval_count", "$.usage.completion_tokens").alias("output_tokens"),
    )


VIEWPORT_SCHEMA = (
    "url string, name string, width int, height int, adCount int, nearInteractiveCount int, misleadingLabelCount int, "
    "intrusiveOverlayCount int, viewportCoverage double, popupAttempts int, adRefreshCount int"
)


def src_viewport_metrics(raw: DataFrame) -> DataFrame:
    """Rendered-layout metrics (payload JSON per page and viewport) with missing counts as zero."""
    r = raw.select(F.from_json("payload", VIEWPORT_SCHEMA).alias("r")).select("r.*")
    return r.fillna(0)
