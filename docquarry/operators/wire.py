"""JSON in and out: embedding requests and responses, search requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.vectors import decode_f32_base64
from docquarry.operators.ingest import BATCH_SIZE

# Fixed values of the protocol.
TOOL = "search_wiki"
VERSION = "2.0"
METHODS = ("initialize", "tools/list", "tools/call")
INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, BACKEND_FAILED = -32600, -32601, -32602, -32000
BAD_VERSION = "Invalid JSON-RPC version"
BAD_METHOD = "Method not found"
BAD_CALL = "Invalid tools/call request"
BAD_TOOL = "Unsupported tool"
NO_ARGUMENTS = "Missing tool arguments"
BAD_QUERY = "Invalid query argument"
NO_EMBEDDINGS = "embedding response did not include any embeddings"


def pack_requests(chunks: DataFrame, model: str, *, batch_size: int = BATCH_SIZE, dimensions: int | None = None) -> DataFrame:
    """Embedding requests of up to ``batch_size`` texts of one document: source_path, batch, n_inputs, body.

    chunk_index runs from 0 without gaps, so the batch is index div size and no window is needed.
    """
    batch = F.floor(F.col("chunk_index") / F.lit(max(1, batch_size))).cast("long")
    grouped = chunks.withColumn("batch", batch).groupBy("source_path", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("_t"))
    body = F.struct(F.lit(model).alias("model"), F.col("_t.text").alias("input"), F.lit(dimensions).cast("int").alias("dimensions"))
    return grouped.select("source_path", "batch", F.size("_t").alias("n_inputs"), F.to_json(body).alias("body"))


def _is_array(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def decode_embedding_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (request_id, item, embedding) of saved responses, and errors (request_id, error).

    ``responses``: request_id, n_inputs, body. Non-empty ``data`` counts first, in order of index (missing:
    0) and place; its vectors are arrays or base64. Then ``embeddings``, then the single ``embedding``.
    """
    schema = "data array<struct<index:long,embedding:string>>, embeddings array<array<float>>, embedding array<float>"
    body = F.from_json("body", schema)
    parsed = responses.select("request_id", "n_inputs", body.alias("b"))
    data = F.array_sort(
        F.transform(F.coalesce("b.data", F.array().cast("array<struct<index:bigint,embedding:string>>")), lambda x, i: F.struct(F.coalesce(x["index"], F.lit(0)).alias("index"), i.alias("place"), x["embedding"].alias("raw")))
    )
    single = F.when(F.col("b.embedding").isNotNull(), F.array(F.col("b.embedding")))
    lists = F.when(F.size(F.col("b.embeddings")) > 0, F.col("b.embeddings")).otherwise(single)
    items = F.when(
        F.size(data) > 0,
        F.transform(data, lambda x: F.struct(x["raw"].alias("raw"), F.lit(None).cast("array<float>").alias("list"))),
    ).otherwise(F.transform(lists, lambda x: F.struct(F.lit(None).cast("string").alias("raw"), x.alias("list"))))
    counted = parsed.select("request_id", "n_inputs", items.alias("items")).withColumn("n", F.coalesce(F.size("items"), F.lit(-1)))
    mismatch = F.format_string("embedding count mismatch: request has %d item(s) but response has %d item(s)", F.col("n_inputs"), F.col("n"))
    found = counted.withColumn("error", F.when(F.col("n") <= 0, NO_EMBEDDINGS).when(F.col("n") != F.col("n_inputs"), mismatch))
    rows = found.where("error is null").select("request_id", F.posexplode("items").alias("item", "x"))
    array = F.from_json(F.when(_is_array(F.col("x.raw")), F.col("x.raw")), "array<float>")
    packed = decode_f32_base64(F.when(~_is_array(F.col("x.raw")), F.col("x.raw")))
    vectors = rows.select("request_id", "item", F.coalesce("x.list", array, packed).alias("embedding"))
    bad = vectors.where("embedding is null").groupBy("request_id").agg(F.lit("invalid embedding value").alias("error"))
    good = vectors.join(bad.select("request_id"), "request_id", "left_anti")
    return good, found.where("error is not null").select("request_id", "error").unionByName(bad)


def parse_search_requests(lines: DataFrame) -> DataFrame:
    """Requests of a log (``line``): id (raw JSON), method, query, error_code, error_message, parse_error.

    Rules apply in order: no or null id (a notification) drops the line; then version, method, parameters,
    tool, arguments, query. A blank line, bad JSON or a missing method is a parse_error and stops nothing.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    value = F.try_parse_json(text)
    top = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    kind = lambda v: F.schema_of_variant(v)
    named = lines.select(
        "line", value.alias("v"), top("id").alias("_id"), top("jsonrpc").alias("_version"), top("method").alias("_method"), top("params").alias("_params")
    )
    is_object = F.coalesce(kind(F.col("v")).startswith("OBJECT"), F.lit(False))
    string = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    absent = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))
    version_ok = F.col("_version").isNull() | string(F.col("_version"))
    broken = ~is_object | ~string(F.col("_method")) | ~version_ok
    params = F.col("_params")
    name = F.try_variant_get(params, "$.name", "variant")
    arguments = F.try_variant_get(params, "$.arguments", "variant")
    query = F.try_variant_get(arguments, "$.query", "variant")
    version = F.coalesce(F.try_variant_get(F.col("_version"), "$", "string"), F.lit(VERSION))
    method = F.try_variant_get(F.col("_method"), "$", "string")
    code_and_message = (
        F.when(version != VERSION, F.struct(F.lit(INVALID_REQUEST).alias("code"), F.lit(BAD_VERSION).alias("message")))
        .when(~method.isin(*METHODS), F.struct(F.lit(METHOD_NOT_FOUND).alias("code"), F.lit(BAD_METHOD).alias("message")))
        .when(method != "tools/call", F.lit(None))
        .when(~F.coalesce(kind(params).startswith("OBJECT"), F.lit(False)) | ~string(name), F.struct(F.lit(INVALID_PARAMS).alias("code"), F.lit(BAD_CALL).alias("message")))
        .when(F.try_variant_get(name, "$", "string") != TOOL, F.struct(F.lit(INVALID_PARAMS).alias("code"), F.lit(BAD_TOOL).alias("message")))
        .when(absent(arguments), F.struct(F.lit(INVALID_PARAMS).alias("code"), F.lit(NO_ARGUMENTS).alias("message")))
        .when(~string(query), F.struct(F.lit(INVALID_PARAMS).alias("code"), F.lit(BAD_QUERY).alias("message")))
    )
    judged = named.select("line", F.col("_id"), broken.alias("parse_error"), method.alias("method"), code_and_message.alias("e"), query.alias("_query"))
    kept = judged.where(F.col("parse_error") | ~absent(F.col("_id")))
    fine = ~F.col("parse_error")
    return kept.select(
        F.when(fine, F.to_json("_id")).alias("id"),
        F.when(fine, F.col("method")).alias("method"),
        F.when(fine & F.col("e").isNull() & (F.col("method") == "tools/call"), F.try_variant_get("_query", "$", "string")).alias("query"),
        F.when(fine, F.col("e.code")).alias("error_code"),
        F.when(fine, F.col("e.message")).alias("error_message"),
        "parse_error",
    )


def format_search_replies(replies: DataFrame) -> DataFrame:
    """``reply`` (JSON line) for rows of id (raw JSON), answer, error_code, error_message, failure.

    An error of the request comes first, then a ``failure`` of the search, then the answer. The id is put
    in as it came.
    """
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("failure").isNotNull(), F.lit(BACKEND_FAILED))
    message = F.when(F.col("error_code").isNotNull(), F.col("error_message")).otherwise(F.col("failure"))
    error = F.to_json(F.struct(code.alias("code"), message.alias("message")))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("answer").alias("text")))
    result = F.to_json(F.struct(content.alias("content"), F.lit(False).alias("isError")))
    head = F.concat(F.lit(f'{{"jsonrpc":"{VERSION}","id":'), F.col("id"))
    said = F.when(code.isNotNull(), F.concat(head, F.lit(',"error":'), error, F.lit("}"))).otherwise(F.concat(head, F.lit(',"result":'), result, F.lit("}")))
    return replies.withColumn("reply", said)
