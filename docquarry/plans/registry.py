"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.plans import queries as q
from docquarry.plans.oracles import ORACLES
from docquarry.plans.queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_markdown": q.clean_markdown,
    "reference_links": q.reference_links,
    "split_sentences": q.split_sentences,
    "pack_sentences": q.sentence_packs,
    "byte_slices": q.slices,
    "chunk_documents": q.chunks,
    "decode_documents": q.decoded,
    "chunk_markdown": q.markdown_chunks,
    "chunk_shapes": q.markdown_shapes,
    "content_hash": q.content_hashes,
    "changed_documents": q.changed_documents,
    "update_ledger": q.update_ledger,
    "ledger_json": q.ledger_json,
    "stable_files": q.stable_files,
    "commit_unchanged": q.commit_unchanged,
    "markdown_changes": q.markdown_changes,
    "point_id": q.point_ids,
    "upsert_points": q.upsert_points,
    "trigrams": q.trigram_sets,
    "jaccard": q.jaccard,
    "quantize": q.quantize,
    "quantized_cosine": q.quantized_cosine,
    "lsh_bucket": q.lsh_bucket,
    "lsh_candidates": q.lsh_candidates,
    "embed_chunk": q.embed_chunk,
    "embed_query": q.embed_query,
    "with_fallback": q.with_fallback,
    "with_query_fallback": q.with_query_fallback,
    "base64_vectors": q.base64_vectors,
    "similarity_join": q.similarity_join,
    "topk_search": q.topk_search,
    "topk_cells": q.topk_cells,
    "answer_queries": q.answer_queries,
    "probe_cache": q.probe_cache,
    "replay_cache": q.replay_cache,
    "cached_search": q.cached_search,
    "debounce": q.debounced,
    "pack_requests": q.pack_requests,
    "decode_responses": q.decode_responses,
    "parse_requests": q.parse_requests,
    "search_replies": q.search_replies,
    "ingest_and_answer": q.flagship,
}
