"""Message decoding, routing and flattening.

An inbox has ``delivery_tag`` and ``body`` (binary or text). Handling order is
``(delivery_tag, pos)`` everywhere downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.functions import text
from coverlane.schemas import MESSAGE_FIELDS, NAME_PARTS

# The two keys that tell the message types apart.
SINGLE_KEY = "NombreCompleto"
BATCH_KEY = "Clientes"

JSON_OPTIONS = {"allowSingleQuotes": "false"}
MAP_TYPE = "map<string,string>"

SINGLE, BATCH, UNKNOWN, BAD_JSON, REJECTED = "single", "batch", "unrecognized", "bad_json", "rejected"
ACK, DEAD_LETTER, RETRY, DROP = "ack", "dead_letter", "retry", "drop"


def is_json(body: Column) -> Column:
    """True if the text is exactly one JSON value.

    ``from_json`` alone stops after the first value, so the text is read as the only
    element of a list: trailing junk then breaks the list or makes it longer. Text that
    closes the list itself and opens another key must also hold as the member of an
    object, which it cannot close with the same bracket.
    """
    listed = F.from_json(F.concat(F.lit('{"x":['), body, F.lit("]}")), "struct<x:array<string>,_corrupt_record:string>", JSON_OPTIONS)
    member = F.from_json(F.concat(F.lit('{"x":{"y":'), body, F.lit("}}")), "struct<x:string,_corrupt_record:string>", JSON_OPTIONS)
    one = listed["_corrupt_record"].isNull() & (F.size(listed["x"]) == 1)
    may_close = F.rlike(body, F.lit(r'\][ \t\r\n]*,[ \t\r\n]*"'))
    return F.coalesce(F.when(one, ~may_close | member["_corrupt_record"].isNull()), F.lit(False))


def _mark(body: Column) -> Column:
    """First character that is not JSON blank: tells the kind of the top-level value."""
    return F.regexp_extract(body, r"^[ \t\r\n]*([^ \t\r\n])", 1)


def parse(inbox: DataFrame) -> DataFrame:
    """Add ``route``, ``disposition``, ``fields`` (map) and ``clients`` (list of JSON texts)."""
    binary = isinstance(inbox.schema["body"].dataType, T.BinaryType)
    body = F.col("body").cast("string")
    readable = F.is_valid_utf8(body) if binary else body.isNotNull()
    step = inbox.withColumn("text", F.when(readable, body))
    step = step.withColumn("mark", F.when(is_json(F.col("text")), _mark(F.col("text"))))
    step = step.withColumn("fields", F.when(F.col("mark") == "{", F.from_json("text", MAP_TYPE, JSON_OPTIONS)))

    mark, content = F.col("mark"), F.col("text")
    listed = F.from_json(content, f"struct<{BATCH_KEY}:array<string>>", JSON_OPTIONS)[BATCH_KEY]
    words = F.from_json(content, "array<string>", JSON_OPTIONS)
    is_single = F.map_contains_key("fields", SINGLE_KEY)
    step = step.withColumn("clients", F.when((mark == "{") & ~is_single & F.map_contains_key("fields", BATCH_KEY), listed))
    route = (
        F.when(content.isNull(), REJECTED)
        .when(mark.isNull(), BAD_JSON)
        .when((mark == "{") & is_single, SINGLE)
        .when((mark == "{") & F.col("clients").isNotNull(), BATCH)
        .when(mark == "{", UNKNOWN)
        .when((mark == "[") & F.array_contains(words, SINGLE_KEY), SINGLE)
        .when((mark == "[") & F.array_contains(words, BATCH_KEY), REJECTED)
        .when(mark == "[", UNKNOWN)
        .when((mark == '"') & F.contains(content, F.lit(SINGLE_KEY)), SINGLE)
        .when((mark == '"') & F.contains(content, F.lit(BATCH_KEY)), REJECTED)
        .when(mark == '"', UNKNOWN)
        .otherwise(REJECTED)
    )
    step = step.withColumn("route", route)
    return step.withColumn("disposition", F.when(F.col("route") == REJECTED, DEAD_LETTER).otherwise(ACK)).drop("mark")


def flatten(parsed: DataFrame) -> DataFrame:
    """One row per client: ``delivery_tag, pos, client`` (JSON text) and its ``fields`` map.

    Both message types go through one generator, so the inbox is read once. Header
    fields of a batch are not copied to its clients.
    """
    def read(client: Column) -> Column:
        fields = F.from_json(client, MAP_TYPE, JSON_OPTIONS)
        return F.struct(client.alias("client"), F.when(F.ltrim(client).startswith("{"), fields).alias("fields"))

    alone = F.array(F.struct(F.col("text").alias("client"), F.col("fields")))
    units = F.when(F.col("route") == SINGLE, alone).when(F.col("route") == BATCH, F.transform("clients", read))

    # Parsed inside the generator, and an outer one: filters on the fields then stay above
    # it, so that each client's text is parsed once.
    rows = parsed.select("delivery_tag", "route", F.posexplode_outer(units).alias("pos", "one"))
    return rows.filter(F.col("pos").isNotNull()).select("delivery_tag", "route", "pos", "one.client", "one.fields")


def typed(clients: DataFrame) -> DataFrame:
    """Message keys as columns. Names default to ''; ids that cannot be read are null."""
    out = []
    for key, name in MESSAGE_FIELDS.items():
        if name in ("invoice_id", "insurer_id"):
            out.append(text.field("fields", key, None).try_cast("bigint").alias(name))
        else:
            default = "" if name in NAME_PARTS or name == "doc_id" else None
            out.append(text.field("fields", key, default).alias(name))
    return clients.select("delivery_tag", "pos", *out).withColumn("full_name", text.full_name(*NAME_PARTS))


def named(clients: DataFrame) -> DataFrame:
    """Clients that name an insurer; the others produce no output."""
    return clients.filter(text.has_value("insurer_name"))


def batch_counts(clients: DataFrame, ok: Column) -> DataFrame:
    return clients.groupBy("delivery_tag").agg(F.count("*").alias("n_clients"), F.count_if(ok).alias("n_ok"))


def envelope(messages: DataFrame, message: Column, catalog: Column, done_at: Column, session_active: Column) -> DataFrame:
    """The combined result kept per handled message."""
    return messages.withColumn(
        "result", F.struct(message.alias("message"), catalog.alias("catalog"),
                           text.iso(done_at).alias("done_at"), session_active.alias("session_active")))


# Scrape tasks --------------------------------------------------------------------


def make_tasks(urls: DataFrame, rendered: Column | None = None, selectors: Column | None = None,
               created: Column | None = None) -> DataFrame:
    """One task per url, as the JSON body that goes to the queue."""
    empty = F.create_map().cast(MAP_TYPE)
    task = F.struct(
        F.col("url").alias("url"),
        F.coalesce(rendered, F.lit(False)).alias("use_selenium") if rendered is not None else F.lit(False).alias("use_selenium"),
        (F.coalesce(selectors, empty) if selectors is not None else empty).alias("selectors"),
        (created if created is not None else F.unix_micros(F.current_timestamp()) / 1e6).alias("timestamp"))
    return urls.withColumn("body", F.to_json(task))


def read_tasks(inbox: DataFrame, attempt: Column | None = None, max_attempts: int | None = None) -> DataFrame:
    """Parse scrape tasks and decide on each: ack, drop (no JSON) or retry (everything else that fails).

    Retried are JSON values other than objects, bodies that are null or no UTF-8, and tasks
    without url. With ``max_attempts`` a retry that has used up its attempts becomes a dead letter.
    """
    body = F.col("body").cast("string")
    readable = F.is_valid_utf8(body) if isinstance(inbox.schema["body"].dataType, T.BinaryType) else body.isNotNull()
    step = inbox.withColumn("_json", F.when(readable, is_json(body)))
    step = step.withColumn("fields", F.when(F.col("_json") & (_mark(body) == "{"), F.from_json(body, MAP_TYPE, JSON_OPTIONS)))
    again = F.lit(RETRY)
    if max_attempts is not None:
        tries = attempt if attempt is not None else F.lit(0)
        again = F.when(tries + 1 >= max_attempts, DEAD_LETTER).otherwise(RETRY)
    url = text.field("fields", "url", None)
    return step.select(
        *inbox.columns,
        url.alias("url"),
        text.flag(text.field("fields", "use_selenium", "false")).alias("rendered"),
        F.from_json(text.field("fields", "selectors", "{}"), MAP_TYPE).alias("selectors"),
        F.when(~F.col("_json"), DROP).when(F.col("fields").isNull() | ~text.has_value(url), again).otherwise(ACK).alias("disposition"))


def scrape_records(scraped: DataFrame, started: Column, finished: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scraped pages as rows of the result table.

    Input: ``url, title, status_code, error, rendered, extracted`` (map), and ``links`` if
    there are any. The whole record, with the time it was made and how long that took, is
    kept as JSON next to the named columns; ``content`` is always empty.
    """
    links = [F.col("links")] if "links" in scraped.columns else []
    record = F.struct("url", "title", "status_code", "error", "rendered", "extracted", *links,
                      (finished / 1e6).alias("timestamp"), text.seconds_between(started, finished).alias("processing_time"))
    return scraped.select(
        *keep,
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.lit("").alias("content"),
        F.col("status_code").cast("int").alias("status_code"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        F.coalesce("rendered", F.lit(False)).alias("rendered"),
        text.seconds_between(started, finished).alias("processing_time"),
        F.to_json(record).alias("extracted"))
