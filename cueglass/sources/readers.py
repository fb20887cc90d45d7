"""Readers for images, OCR results, the catalog, feeds and transcription results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueglass import schemas
from cueglass.config import DEFAULT, Limits
from cueglass.functions.text import non_empty, plain_spaces, title_norm, trim_blank
from cueglass.functions.timefmt import file_size_mb
from cueglass.operators import episode_scores
from cueglass.operators.catalog import norm_texts, podcast_pairs
from cueglass.operators.episode_search import by_podcast_size
from cueglass.operators.scale import cut, first_by, shuffled


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size in bytes and kind of each file; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    kind = F.when(suffix.isin("png", "webp", "gif", "bmp"), F.concat(F.lit("image/"), suffix)).when(
        suffix.isin("jpg", "jpeg"), "image/jpeg"
    )
    return files.select("path", "length", F.coalesce(kind, F.lit("other")).alias("mime"))


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Width and height of each image, null where the file cannot be decoded."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path)
    known = F.col("image.height") > 0
    return images.select(
        F.col("image.origin").alias("path"),
        F.when(known, F.col("image.width")).alias("width"),
        F.when(known, F.col("image.height")).alias("height"),
    )


def accept_requests(screenshots: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Files of requests that hold 1 to 5 images of at most 10 MB; one bad file rejects
    its whole request. Adds the size in MB and a warning flag."""
    verdicts = screenshots.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_and(F.coalesce(F.col("mime").startswith("image/"), F.lit(False))).alias("images"),
        F.max("length").alias("largest"),
    )
    good = verdicts.where(
        (F.col("files") <= limits.max_files)
        & F.col("images")
        & (F.col("largest") <= limits.max_file_bytes)
    )
    return (
        screenshots.join(good.select("request_id"), "request_id", "left_semi")
        .withColumn("size_mb", file_size_mb(F.col("length")))
        .withColumn("is_large", F.col("length") / 1048576 > limits.warn_file_mb)
    )


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """OCR results, one JSON object a line; a line that is none keeps its text in
    ``_corrupt_record`` and goes on to :func:`ocr_errors`."""
    schema = f"{schemas.OCR_ANNOTATIONS}, {schemas.BAD_LINE} string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", schemas.BAD_LINE).json(path)


def ocr_errors(annotations: DataFrame) -> DataFrame:
    """``(image_id, error, raw_text)``: an error row for every line that cannot be used."""
    bad = F.col(schemas.BAD_LINE)
    error = F.when(bad.isNotNull(), "Unreadable OCR result").when(
        F.col("image_id").isNull(), "OCR result without image"
    )
    return annotations.select("image_id", error.alias("error"), bad.alias("raw_text")).where(
        F.col("error").isNotNull()
    )


def ocr_texts(annotations: DataFrame) -> DataFrame:
    """Full text of each image; images without any text are left out."""
    full = F.get("textAnnotations", F.lit(0)).description
    return annotations.select("image_id", plain_spaces(full).alias("full_text")).where(
        F.col("full_text").isNotNull()
    )


def ocr_words(annotations: DataFrame) -> DataFrame:
    """One row per word: all annotations after the first, with three box corners."""
    words = F.slice(
        "textAnnotations", 2, F.greatest(F.size("textAnnotations") - 1, F.lit(0))
    )
    rows = annotations.where(F.size("textAnnotations") > 1).select(
        "image_id", F.posexplode(words).alias("word_idx", "w")
    )
    corner = lambda i: F.get("w.boundingPoly.vertices", F.lit(i))
    return rows.select(
        "image_id",
        "word_idx",
        plain_spaces(F.col("w.description")).alias("text"),
        *[
            F.coalesce(corner(i)[axis], F.lit(0)).alias(f"{axis}{i}")
            for i in range(3)
            for axis in ("x", "y")
        ],
    )


def read_podcasts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.PODCASTS).parquet(path)
    return df.withColumn("title", trim_blank(plain_spaces(F.col("title"))))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.EPISODES).parquet(path)
    return df.withColumn("title", trim_blank(plain_spaces(F.col("title"))))


def podcast_details(ids: DataFrame, podcasts: DataFrame) -> DataFrame:
    """Details per podcast id; here the large artwork goes before the small one."""
    art = F.coalesce(non_empty(F.col("artwork_600")), non_empty(F.col("artwork_100")))
    return ids.join(podcasts, "podcast_id", "left").select(
        *ids.columns, "title", "artist", "feed_url", art.alias("artwork_url"), "description", "genres"
    )


def listed_podcasts(found: DataFrame, podcasts: DataFrame) -> DataFrame:
    """Search result rows with catalog fields; the small artwork goes first."""
    art = F.coalesce(non_empty(F.col("artwork_100")), non_empty(F.col("artwork_600")))
    return found.join(podcasts, "podcast_id").select(
        *found.columns, "title", "artist", "feed_url", art.alias("artwork_url")
    )


# --- feeds ----------------------------------------------------------------------------


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS documents ``(podcast_id, xml)``; a broken feed has none."""
    parsed = F.from_xml("xml", schemas.FEED_XML, {"rowTag": "rss"})
    items = F.get(F.col("rss.channel"), F.lit(0)).item
    rows = feeds.select("podcast_id", parsed.alias("rss")).select(
        "podcast_id", F.posexplode(items).alias("pos", "item")
    )
    enclosure = F.get("item.enclosure", F.lit(0))
    return rows.select(
        "podcast_id",
        "pos",
        F.get("item.title", F.lit(0)).alias("title"),
        enclosure["_url"].alias("url"),
        enclosure["_type"].alias("type"),
        enclosure["_length"].alias("length"),
    )


_ITEM = ["pos", "title", "url", "type", "length"]


def first_similar_items(
    requests: DataFrame, items: DataFrame, limits: Limits = DEFAULT, every: bool = False
) -> DataFrame:
    """First item of the feed (not the best) that is more than 0.7 similar.

    For each distinct ``(podcast_id, term)``, with ``every`` also for those without an item.
    Both tables are read once. Small feeds are compared item by item; large ones go through
    the blocked join. Texts without a letter or digit count as contained in any other text.
    """
    asked = cut(requests.select("podcast_id", "term"))
    named = cut(items.where(F.length("title") > 0).select("podcast_id", *_ITEM))

    def of_few(asked: DataFrame, named: DataFrame) -> DataFrame:
        found = episode_scores.score_podcasts(
            asked, named,
            {"norm": lambda c: title_norm(c("term"))}, {"norm": lambda c: title_norm(c("title")), "ord": "pos"},
            _ITEM, episode_scores.first_similar(limits.feed_item_similarity), episode_scores.best_row, every,
        ).select("podcast_id", "term", *_ITEM)
        nowhere = asked.where("podcast_id is null").distinct()
        return found.unionByName(nowhere, allowMissingColumns=True) if every else found

    def of_many(asked: DataFrame, named: DataFrame) -> DataFrame:
        asked = cut(asked.distinct())
        found = _first_by_index(asked, named, limits)
        return asked.join(found, ["podcast_id", "term"], "left") if every else found

    return by_podcast_size(asked, named, limits, of_few, of_many)


def _first_by_index(requests: DataFrame, named: DataFrame, limits: Limits) -> DataFrame:
    asked = cut(requests.select("podcast_id", "term", title_norm(F.col("term")).alias("n")))
    # Copies of a text are one text: only its first item can be the answer.
    texts = named.withColumn("m", title_norm(F.col("title")))
    per_text = cut(first_by(texts, ["podcast_id", "m"], [F.col("pos")]))
    pairs = podcast_pairs(
        norm_texts(asked, "term", ["podcast_id"]),
        norm_texts(per_text, "title", ["podcast_id"]),
        limits.feed_item_similarity,
        limits,
    ).select("podcast_id", F.col("term").alias("n"), F.col("title").alias("m"))
    fields = ["podcast_id", "term", *_ITEM]
    has_word = lambda name: F.col(name).rlike(r"\S")
    any_item = first_by(per_text.drop("m"), ["podcast_id"], [F.col("pos")])
    blank_item = first_by(per_text.where(~has_word("m")).drop("m"), ["podcast_id"], [F.col("pos")])
    hits = (
        asked.join(shuffled(pairs), ["podcast_id", "n"])
        .join(shuffled(per_text), ["podcast_id", "m"])
        .select(*fields)
        .unionByName(asked.where(has_word("n")).join(blank_item, "podcast_id").select(*fields))
        .unionByName(asked.where(~has_word("n")).join(any_item, "podcast_id").select(*fields))
    )
    return first_by(hits, ["podcast_id", "term"], [F.col("pos")])


def audio_urls(requests: DataFrame, items: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(podcast_id, term, audio_url, audio_type, audio_length)``; null without a match
    or without an enclosure address."""
    found = first_similar_items(requests, items, limits, every=True)
    has_url = F.length("url") > 0
    return found.select(
        "podcast_id",
        "term",
        F.when(has_url, F.col("url")).alias("audio_url"),
        F.when(has_url, F.coalesce(non_empty(F.col("type")), F.lit("unknown"))).alias("audio_type"),
        F.when(has_url, F.coalesce(non_empty(F.col("length")), F.lit("unknown"))).alias(
            "audio_length"
        ),
    )


# --- transcription results ------------------------------------------------------------


def read_transcript_results(spark: SparkSession, path: str) -> DataFrame:
    """Transcription results with defaults for missing parts."""
    df = spark.read.schema(schemas.TRANSCRIPT_RESULTS).json(path)
    types = {f.name: f.dataType for f in df.schema}
    return df.select(
        "clip_id",
        F.coalesce(plain_spaces(F.col("text")), F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("words", F.array().cast(types["words"])).alias("words"),
        F.coalesce("utterances", F.array().cast(types["utterances"])).alias("utterances"),
    )


def transcript_words(results: DataFrame) -> DataFrame:
    return results.select("clip_id", F.posexplode("words").alias("word_index", "w")).select(
        "clip_id",
        "word_index",
        "w.text",
        F.col("w.start").alias("start_ms"),
        F.col("w.end").alias("end_ms"),
        "w.confidence",
    )


def transcript_utterances(results: DataFrame) -> DataFrame:
    return results.select("clip_id", F.posexplode("utterances").alias("seq", "u")).select(
        "clip_id", "seq", "u.speaker", "u.text"
    )

