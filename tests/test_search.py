import random
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions.vectors import bytes_vector
from docquarry.operators import cache as ca
from docquarry.operators import search as se
from docquarry.operators import wire as wi
from docquarry.streaming.stateful import stream_cache


def tables(spark, n=60, dim=6):
    rng = random.Random(3)
    points = [(f"p{i:03}", f"f{i}", f"text {i}", [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    points += [("dup1", "x", "t", points[0][3]), ("dup0", "x", "t", points[0][3]), ("none", "x", "t", None), ("short", "x", "t", [1.0]), ("zero", "x", "t", [0.0] * dim)]
    queries = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(12)] + [(50, points[0][3]), (51, None)]
    return (
        spark.createDataFrame(queries, "query_id long, embedding array<float>"),
        spark.createDataFrame(points, "point_id string, source_path string, text string, embedding array<float>"),
    )


def test_top_k_equals_expressions(spark):
    queries, points = tables(spark)
    every = queries.crossJoin(points.withColumnRenamed("embedding", "e")).where("size(embedding) = size(e) and embedding is not null and e is not null")
    pairs = every.select("query_id", "point_id", se.cosine(F.col("embedding"), F.col("e")).alias("score")).collect()
    for block in (0, 3):
        got = {(r["query_id"], r["point_id"]): round(r["score"], 9) for r in se.similarity_join(queries, points, query_block=block).collect()}
        assert got == {(r["query_id"], r["point_id"]): round(r["score"], 9) for r in pairs}
    want = {}
    for q in {r["query_id"] for r in pairs}:
        own = sorted((-round(r["score"], 6), r["point_id"]) for r in pairs if r["query_id"] == q)[:5]
        want[q] = [p for _, p in own]
    for block in (2048, 3):
        got = se.top_k(queries, points, 5, query_block=block).orderBy("query_id", "rank").collect()
        found = {}
        for r in got:
            found.setdefault(r["query_id"], []).append(r["point_id"])
        assert found == want
    assert want[50][:3] == ["dup0", "dup1", "p000"]


def test_pairs_come_in_bounded_batches(spark):
    ids, points = pa.array(range(50)), pa.array([[float(i % 7), float(i % 11), 1.0] for i in range(900)], pa.list_(pa.float32()))
    held = list(se._pairs(ids, points.slice(0, 50), pa.array([f"p{i}" for i in range(900)]), points, 2000))
    assert max(b.num_rows for b in held) == 1800 and sum(b.num_rows for b in held) == 50 * 900
    queries = spark.createDataFrame([(i, points[i].as_py()) for i in range(50)], "query_id long, embedding array<float>")
    frame = spark.createDataFrame([(f"p{i}", v.as_py()) for i, v in enumerate(points)], "point_id string, embedding array<float>")
    joined = se.similarity_join(queries, frame)
    # No row of a block's pairs waits for the others: blocks meet in a join and are streamed on.
    assert "CoGroups" not in joined._jdf.queryExecution().toString()
    got = {(r["query_id"], r["point_id"]): r["score"] for r in joined.collect()}
    want = {(q, p): s for b in held for q, p, s in zip(*(c.to_pylist() for c in b.columns))}
    assert len(got) == 45000 and all(abs(got[k] - s) < 1e-9 for k, s in want.items())


def test_answers(spark):
    queries, points = tables(spark)
    got = {r["query_id"]: r["answer"] for r in se.search(queries, points, 2).collect()}
    assert got[50] == "t\n---\nt" and got[51] == se.NO_MATCH and len(got) == 14
    assert {r["answer"] for r in se.search(queries, points.limit(0)).collect()} == {se.NO_MATCH}
    assert se.search(queries.limit(0), points).count() == 0


def plain_replay(log, size, dim, bits):
    """The cache rule over lists."""
    from docquarry.functions.vectors import buckets, quantized

    def coded(q):
        v, s, n = quantized(bytes_vector(q, dim, True)[None, :])
        return v[0].astype(int), float(s[0]), float(n[0]), int(buckets(v, bits, 0xC0FFEE)[0])

    def grams(q):
        raw = q.encode()
        return {raw[i : i + 3] for i in range(len(raw) - 2)}

    out, caches = [], {}
    for shard, seq, query, value in sorted(log):
        entries, order = caches.setdefault(shard, (OrderedDict(), []))
        v, s, n, b = coded(query)
        best, score = None, -9.0
        for key in order:
            w, t, m, c, _ = entries[key]
            if c == b:
                x = float(v @ w) * s * t / (n * m) if n and m else 0.0
                if x > score + 1e-9:
                    best, score = key, x
        hit = None
        if best is not None and score >= 0.95:
            hit = "SureHit"
        elif best is not None and score >= 0.85:
            a, c = grams(query), grams(best)
            if (len(a & c) / len(a | c) if a | c else 1.0) >= 0.25:
                hit = "GreyZone"
        if hit:
            entries.move_to_end(best)
            out.append((shard, seq, hit, best, entries[best][4]))
            continue
        if query in entries:
            order.remove(query)
            del entries[query]
        entries[query] = (v, s, n, b, value)
        order.append(query)
        if len(entries) > size:
            old, _ = entries.popitem(last=False)
            order.remove(old)
        out.append((shard, seq, "Miss", None, value))
    return sorted(out)


def query_log():
    rng = random.Random(4)
    base = ["how do I start the server", "what is a chunk", "list all notes", "", "ab", "where are the vectors kept"]
    log = []
    for shard in ("u1", "u2", "u3"):
        for seq in range(40):
            q = rng.choice(base)
            if rng.random() < 0.3 and q:
                q = q[:-1] + rng.choice("xyz")
            log.append((shard, seq, q, f"answer {shard} {seq}"))
    return log


def test_replay(spark):
    log = query_log()
    frame = spark.createDataFrame(log, "user string, n long, query string, value string")
    got = ca.replay_cache(frame, "user", "n", max_entries=4, dim=16, num_bits=4).collect()
    found = sorted((r["shard"], r["seq"], r["outcome"], r["matched_query"], r["value"]) for r in got)
    assert found == plain_replay(log, 4, 16, 4)
    assert {r["outcome"] for r in got} == {"SureHit", "GreyZone", "Miss"} or {r["outcome"] for r in got} == {"SureHit", "Miss"}


def test_stream_of_queries(spark, tmp_path, rocksdb):
    log = query_log()
    frame = spark.createDataFrame(log, "user string, n long, query string, value string")
    for k in range(2):
        frame.where((F.col("n") >= 20 * k) & (F.col("n") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_cache(source, "user", "n", max_entries=4, dim=16, num_bits=4)
    query = out.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = sorted((r["shard"], r["seq"], r["outcome"], r["matched_query"], r["value"]) for r in spark.table("replayed").collect())
    assert len(got) == len(log)
    assert got == plain_replay(log, 4, 16, 4)


def test_probe_and_cached_search(spark):
    cache = spark.createDataFrame([("Arc<RwLock<T>>", "cached", 0), ("", "empty", 1)], "query string, value string, seq long")
    cached = ca.cache_entries(cache, dim=8, num_bits=16)
    asked = spark.createDataFrame([(1, "Arc<RwLock<T>>"), (2, ""), (3, "something quite different"), (4, "something quite different")], "query_id long, query string")
    found = {r["query_id"]: r for r in ca.probe_cache(ca.cache_entries(asked, dim=8, num_bits=16), cached).collect()}
    assert (found[1]["outcome"], found[1]["value"]) == ("SureHit", "cached")
    assert found[2]["outcome"] == "Miss" and found[3]["outcome"] == "Miss" and len(found) == 4
    answers, after = ca.answer_queries(asked, cached, lambda m: m.select("query_id", F.concat(F.lit("fresh "), "query").alias("answer")), dim=8, num_bits=16)
    got = {r["query_id"]: (r["outcome"], r["answer"]) for r in answers.collect()}
    assert got == {1: ("SureHit", "cached"), 2: ("Miss", "fresh "), 3: ("Miss", "fresh something quite different"), 4: ("Miss", "fresh something quite different")}
    assert sorted((r["query"], r["value"]) for r in after.collect()) == [("", "fresh "), ("Arc<RwLock<T>>", "cached"), ("something quite different", "fresh something quite different")]


def test_requests(spark):
    call = '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"search_wiki","arguments":{"query":"x"}}}'
    cases = {
        call: ("1", "x", None, None),
        " " + call.replace('"id":1', '"id":"a"') + "\n": ('"a"', "x", None, None),
        call.replace('"2.0"', '"1.0"'): ("1", None, -32600, "Invalid JSON-RPC version"),
        call.replace('"jsonrpc":"2.0",', ""): ("1", "x", None, None),
        call.replace("tools/call", "foo"): ("1", None, -32601, "Method not found"),
        call.replace("tools/call", "tools/list"): ("1", None, None, None),
        '{"id":1,"method":"tools/call"}': ("1", None, -32602, "Invalid tools/call request"),
        call.replace("search_wiki", "other"): ("1", None, -32602, "Unsupported tool"),
        '{"id":1,"method":"tools/call","params":{"name":"search_wiki"}}': ("1", None, -32602, "Missing tool arguments"),
        '{"id":1,"method":"tools/call","params":{"name":"search_wiki","arguments":null}}': ("1", None, -32602, "Missing tool arguments"),
        call.replace('"x"', "5"): ("1", None, -32602, "Invalid query argument"),
    }
    dropped = [call.replace('"id":1,', ""), call.replace('"id":1', '"id":null')]
    broken = ["", "{oops", "[1]", '{"id":1}']
    lines = spark.createDataFrame([(x,) for x in [*cases, *dropped, *broken]], "line string").coalesce(1)
    got = wi.parse_search_requests(lines).collect()
    assert [(r["id"], r["query"], r["error_code"], r["error_message"]) for r in got if not r["parse_error"]] == list(cases.values())
    assert sum(r["parse_error"] for r in got) == len(broken)


def test_replies(spark):
    rows = [("1", "hi \"there\"", None, None, None), ('"a"', None, -32601, "Method not found", None), ("2", None, None, None, "down")]
    frame = spark.createDataFrame(rows, "id string, answer string, error_code int, error_message string, failure string")
    got = [r["reply"] for r in wi.format_search_replies(frame).collect()]
    assert got == [
        '{"jsonrpc":"2.0","id":1,"result":{"content":[{"type":"text","text":"hi \\"there\\""}],"isError":false}}',
        '{"jsonrpc":"2.0","id":"a","error":{"code":-32601,"message":"Method not found"}}',
        '{"jsonrpc":"2.0","id":2,"error":{"code":-32000,"message":"down"}}',
    ]


def test_responses(spark):
    bodies = {
        '{"data":[{"index":1,"embedding":[2.0]},{"index":0,"embedding":[1.0]}]}': [[1.0], [2.0]],
        '{"data":[{"embedding":"AACAPwAAAEA="}]}': [[1.0, 2.0]],
        '{"embeddings":[[1.0],[2.0]]}': [[1.0], [2.0]],
        '{"embedding":[1.0]}': [[1.0]],
    }
    rows = [(i, len(v), b) for i, (b, v) in enumerate(bodies.items())]
    rows += [(10, 1, "{}"), (11, 1, '{"data":[{"embedding":"AAAA"}]}'), (12, 3, '{"embedding":[1.0]}'), (13, 1, "nonsense")]
    good, bad = wi.decode_embedding_responses(spark.createDataFrame(rows, "request_id long, n_inputs int, body string"))
    found = {}
    for r in good.orderBy("request_id", "item").collect():
        found.setdefault(r["request_id"], []).append(r["embedding"])
    assert [found[i] for i in range(4)] == list(bodies.values())
    errors = {r["request_id"]: r["error"] for r in bad.collect()}
    assert sorted(errors) == [10, 11, 12, 13] and "did not include" in errors[10] and "count mismatch" in errors[12]


def test_packing(spark):
    frame = spark.createDataFrame([("a", i, f"t{i}") for i in range(5)], "source_path string, chunk_index long, text string")
    got = wi.pack_requests(frame, "m", batch_size=2, dimensions=8).orderBy("batch").collect()
    assert [r["n_inputs"] for r in got] == [2, 2, 1] and got[0]["body"] == '{"model":"m","input":["t0","t1"],"dimensions":8}'
