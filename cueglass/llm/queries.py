"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueglass.llm import chat, decontaminate, toxicity
from cueglass.llm.collocations import collocations
from cueglass.llm.fingerprint import fingerprint_documents
from cueglass.llm.html_text import extract_text
from cueglass.llm.lexical_search import search_documents
from cueglass.llm.near_dedup import near_duplicates
from cueglass.llm.packing import pack_documents
from cueglass.llm.sharding import shuffle_into_shards
from cueglass.llm.simhash import simhash_components
from cueglass.llm.token_scan import document_tokens
from cueglass.llm.url_filter import judge_urls

#: Rules of the URL query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SHARDS, SEED = 40, 2024
#: The conversation that is added to the table: both turns hold control strings.
ESCAPE_TEST = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, folder, "pages"), rules)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shuffle_into_shards(_table(spark, folder, "documents"), SHARDS, SEED)


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", ESCAPE_TEST), (-7, 1, "assistant", ESCAPE_TEST)]
    rows = rows.union(spark.createDataFrame(added, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.render(chat.events_of_rows(rows)))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(_table(spark, folder, "pages"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(_table(spark, folder, "documents"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = _table(spark, folder, "benchmark")
    return decontaminate.find_passages(_table(spark, folder, "documents"), benchmark)


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(_table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_token_counts": op6_token_counts,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}
