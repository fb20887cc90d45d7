"""Screens, catalog, feeds, transcripts and selections derived from the given tables.

The tables hold orders, parts, texts and conversations. Each function is a plain
projection of whole tables onto one input of the library; ``oracles.py`` repeats them
in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueglass.operators.scale import shuffled
from cueglass.operators.transcript import index_utterance_words


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def part_title() -> Column:
    return F.concat_ws(" ", "p_name", "p_brand", "p_type")


def noisy_title(title: Column) -> Column:
    """As a screen may show it: a lost digit, or the first word scrolled away."""
    return F.when(F.length(title) % 2 == 0, F.regexp_replace(title, r"(\d)\d ", "$1 ")).otherwise(
        F.regexp_replace(title, r"^\S+ ", "")
    )


def noisy_episode(title: Column) -> Column:
    return F.when(F.length(title) % 2 == 0, F.regexp_replace(title, r"^\d-", "")).otherwise(
        F.regexp_replace(title, r".\z", "")
    )


def line_order() -> Column:
    """A unique integer per item of an order."""
    return (
        F.col("l_linenumber") * F.lit(10**16) + F.col("l_partkey") * F.lit(10**8)
        + F.col("l_suppkey") * F.lit(10)
    )


# --- catalog --------------------------------------------------------------------------


def podcasts(t: Tables) -> DataFrame:
    """Every part is a podcast; some share a title."""
    return t.part.select(F.col("p_partkey").alias("podcast_id"), part_title().alias("title"))


def podcast_terms(t: Tables) -> DataFrame:
    return podcasts(t).select("podcast_id", noisy_title(F.col("title")).alias("term"))


def _episode_title() -> Column:
    """Some podcasts have an episode that is called almost as they are."""
    return F.when(
        F.col("l_orderkey") % 5 == 4, F.concat("podcast_title", F.lit(" Bonus"))
    ).otherwise(F.concat_ws(" ", "o_orderpriority", "s_name", F.date_format("o_orderdate", "MMMM")))


def _priced_items(t: Tables) -> DataFrame:
    """Every order item with its order's and its supplier's share of an episode title.

    Items are moved while they are but numbers; the longest texts, those of podcasts, are
    left to the caller, who joins them last.
    """
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    # A title that does not show them needs them no longer, once the joins have found them.
    shown = F.coalesce(F.col("l_orderkey") % 5 != 4, F.lit(True))
    return items.join(orders, "l_orderkey").join(suppliers, "l_suppkey").withColumns(
        {c: F.when(shown, F.col(c)) for c in ("o_orderpriority", "o_orderdate", "s_name")}
    )


def _named_items(t: Tables) -> DataFrame:
    """Every order item with its podcast and episode title, the items of a podcast together."""
    return (
        _priced_items(t)
        .withColumn("podcast_id", F.col("l_partkey"))
        .join(podcasts(t).withColumnRenamed("title", "podcast_title"), "podcast_id")
        .withColumn("title", _episode_title())
    )


def episodes(t: Tables) -> DataFrame:
    return (
        _named_items(t)
        .groupBy("podcast_id", "title")
        .agg(
            F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("episode_id"),
            F.max("l_shipdate").alias("release_date"),
        )
    )


def episode_terms(t: Tables, listed: DataFrame | None = None) -> DataFrame:
    """One request for every episode, as a screen may show its title. ``listed`` is what
    :func:`episodes` gave, if it is at hand."""
    listed = episodes(t) if listed is None else listed
    return listed.select("podcast_id", noisy_episode(F.col("title")).alias("term")).distinct()


def last_episode_terms(t: Tables) -> DataFrame:
    """One request per podcast: its last title in the alphabet, as a screen may show it."""
    last = episodes(t).groupBy("podcast_id").agg(F.max("title").alias("title"))
    return last.select("podcast_id", noisy_episode(F.col("title")).alias("term"))


def words(t: Tables) -> DataFrame:
    """Every word of every document, once; words end at blanks and line ends."""
    return t.documents.select(F.explode(F.split("text", "[ \n]")).alias("word")).distinct()


def short_lines(t: Tables) -> DataFrame:
    """Every line of one or two words in any document, once."""
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("title"))
    return lines.where(F.size(F.split("title", " ")) <= 2).distinct()


def text_pairs(t: Tables) -> DataFrame:
    return (
        podcast_terms(t)
        .withColumnRenamed("term", "podcast_text")
        .join(last_episode_terms(t).withColumnRenamed("term", "episode_text"), "podcast_id")
        .select("podcast_text", "episode_text")
        .distinct()
    )


def title_pairs(t: Tables) -> DataFrame:
    """Titles of the parts whose keys are an item's part and supplier."""
    titles = t.part.select("p_partkey", part_title().alias("title"))
    keys = t.lineitem.select(F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id")).distinct()
    left = titles.select(F.col("p_partkey").alias("a_id"), F.col("title").alias("a"))
    right = titles.select(F.col("p_partkey").alias("b_id"), F.col("title").alias("b"))
    return keys.join(left, "a_id").join(right, "b_id")


def feed_items(t: Tables, listed: DataFrame | None = None) -> DataFrame:
    e = episodes(t) if listed is None else listed
    has_file = F.length("title") % 5 != 0
    return e.select(
        "podcast_id",
        F.col("episode_id").alias("pos"),
        "title",
        F.when(
            has_file, F.concat(F.lit("https://media.example/"), F.col("episode_id"), F.lit(".mp3"))
        ).alias("url"),
        F.when(has_file, "audio/mpeg").alias("type"),
        F.when(has_file, F.length("title").cast("string")).alias("length"),
    )


def feed_xml(t: Tables, listed: DataFrame | None = None) -> DataFrame:
    """The feed of each podcast as one RSS document, items by episode id."""
    # The episodes of a podcast are brought together before their items are written out.
    listed = (episodes(t) if listed is None else listed).repartition("podcast_id")
    enclosure = F.when(
        F.col("url").isNotNull(),
        F.concat(
            F.lit('<enclosure url="'), F.col("url"), F.lit('" type="'), F.col("type"),
            F.lit('" length="'), F.col("length"), F.lit('"/>'),
        ),
    ).otherwise("")
    item = F.concat(F.lit("<item><title>"), F.col("title"), F.lit("</title>"), enclosure, F.lit("</item>"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))))
    return (
        feed_items(t, listed)
        .groupBy("podcast_id")
        .agg(F.array_join(F.transform(ordered, lambda i: i.item), "").alias("items"))
        .select(
            "podcast_id",
            F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("xml"),
        )
    )


# --- screens --------------------------------------------------------------------------


def heights(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("image_id"),
        (F.floor(F.col("o_totalprice") % 2000).cast("int") + 800).alias("height"),
    )


def lines(t: Tables) -> DataFrame:
    """One line per order item."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), part_title().alias("text"))
    big = F.col("l_discount") > 0.08
    return t.lineitem.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("image_id"),
        line_order().alias("line_key"),
        "text",
        (F.col("l_quantity") * 40).alias("avg_y"),
        F.when(big, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") / 10).alias("avg_area"),
        F.lit(4).alias("word_count"),
    )


def name_words(t: Tables) -> DataFrame:
    """OCR words: the words of each item's part name, some with a colon behind them."""
    shown = F.concat("p_name", F.when(F.col("p_type") == "PROMO", " :").otherwise(""))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.split(shown, " ").alias("words"))
    rows = t.lineitem.join(parts, "l_partkey").select("*", F.posexplode("words").alias("pos", "text"))
    x = F.col("pos") * 120 + F.col("l_suppkey")
    y = F.col("l_quantity") * 8
    return rows.select(
        F.col("l_orderkey").alias("image_id"),
        (line_order() + F.col("pos")).alias("word_idx"),
        line_order().alias("line_key"),
        "text",
        x.cast("int").alias("x0"),
        y.cast("int").alias("y0"),
        (x + F.length("text") * 10).cast("int").alias("x1"),
        y.cast("int").alias("y1"),
        (x + F.length("text") * 10).cast("int").alias("x2"),
        (y + 20 + F.col("l_partkey") % 5 * 8).cast("int").alias("y2"),
    )


def player_words(t: Tables) -> DataFrame:
    """OCR words of player screens, one screen per order.

    Each item shows its episode title, its podcast as a screen may cut it, and below
    them a playback position. On every fifth screen the podcast stands above the episode;
    on another fifth the episode's month and place are lost among other words, so that
    only keywords find it; on another the two titles are too alike to make a pair.
    """
    kind = F.col("l_orderkey") % 5
    clock = F.concat(
        (F.col("l_partkey") % 60).cast("string"),
        F.lit(":"),
        F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"),
    )
    last_two = F.slice(F.reverse(F.split("title", " ")), 1, 2)
    wordy = F.concat_ws(" ", last_two, F.lit("on air ab cd ef gh ij kl mn"))
    episode = F.when(kind == 3, wordy).otherwise(F.col("title"))
    podcast = F.when(kind == 4, F.col("podcast_title")).otherwise(noisy_title(F.col("podcast_title")))
    above = (kind == 2).cast("int")
    shown = F.array(
        F.struct(above.alias("line"), F.lit(60).alias("h"), episode.alias("text")),
        F.struct((1 - above).alias("line"), F.lit(56).alias("h"), podcast.alias("text")),
        F.struct(F.lit(2).alias("line"), F.lit(30).alias("h"), clock.alias("text")),
    )
    shows = podcasts(t).select(F.col("podcast_id").alias("l_partkey"), F.col("title").alias("podcast_title"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    words = (
        # The last join brings the items of a screen together, so titles and words are not moved.
        items.join(suppliers, "l_suppkey").join(shows, "l_partkey").join(shuffled(orders), "l_orderkey")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "podcast_title",
                _episode_title().alias("title"))
        .distinct()
        .withColumn("s", F.explode(shown))
        .select("*", F.posexplode(F.split("s.text", " ")).alias("pos", "word"))
    )
    x = F.col("pos") * 300
    y = F.col("l_linenumber") * 2600 + F.col("l_partkey") % 12 * 210 + F.col("s.line") * 70
    right = x + F.length("word") * 14
    return words.select(
        F.col("l_orderkey").alias("image_id"),
        (line_order() * 10 + F.col("s.line") * 20 + F.col("pos")).alias("word_idx"),
        F.col("word").alias("text"),
        x.alias("x0"),
        y.alias("y0"),
        right.alias("x1"),
        y.alias("y1"),
        right.alias("x2"),
        (y + F.col("s.h")).alias("y2"),
    )


def player_texts(words: DataFrame) -> DataFrame:
    """Full text of each player screen; orders without items show nothing."""
    ordered = F.sort_array(F.collect_list(F.struct("word_idx", "text")))
    return words.groupBy("image_id").agg(
        F.array_join(F.transform(ordered, lambda w: w.text), " ").alias("full_text")
    )


def player_screens(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_orderstatus") != "F", F.lit(20000)).alias("height"),
    )


def text_lines(t: Tables) -> DataFrame:
    """Lines of all documents, dates of all orders, titles of all parts."""
    docs = t.documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        F.posexplode(F.split("text", "\n")).alias("n", "text"),
    )
    p = F.col("o_orderpriority")
    day = (
        F.when(p == "1-URGENT", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(p == "2-HIGH", F.date_format("o_orderdate", "d MMMM"))
        .when(p == "3-MEDIUM", F.date_format("o_orderdate", "MMMM d"))
        .when(p == "4-NOT SPECIFIED", F.date_format("o_orderdate", "d 'de' MMMM"))
        .otherwise(F.date_format("o_orderdate", "HH:mm"))
    )
    dates = t.orders.select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("n"), day.alias("text")
    )
    parts = t.part.select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.lit(0).alias("n"),
        part_title().alias("text"),
    )
    rows = docs.unionByName(dates).unionByName(parts)
    return rows.withColumns(
        {
            "avg_area": ((F.col("id") * 37 + F.col("n") * 101 + 1900) % 9000).cast("double"),
            "word_count": F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))),
        }
    )


def clock_times() -> tuple[Column, Column]:
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    short = F.concat(F.minute("ts").cast("string"), F.lit(":"), two(F.second("ts")))
    long = F.concat(F.hour("ts").cast("string"), F.lit(":"), two(F.minute("ts")), F.lit(":"), two(F.second("ts")))
    return short, long


def time_screens(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Placed lines and full texts with times, one screen per event."""
    short, long = clock_times()
    kind = F.col("event_type")
    upper = (
        F.when(kind == "click", F.concat(F.lit("-"), short))
        .when(kind == "error", F.lit("no time here"))
        .otherwise(F.concat(F.lit("now "), short))
    )
    lower = (
        F.when(kind == "purchase", F.concat(long, F.lit(" am")))
        .when(kind == "error", F.lit("nor here"))
        .otherwise(F.concat(long, F.lit(" left")))
    )
    e = t.events.select(
        F.col("event_id").alias("image_id"), "value", kind.alias("kind"),
        upper.alias("upper"), lower.alias("lower"), short.alias("short"), long.alias("long"),
    )
    rest = F.when(F.col("kind") == "error", F.concat(F.lit(" | "), "long", F.lit(" pm | some more words in between | "), "short")).otherwise("")
    texts = e.select("image_id", "short", F.concat("upper", F.lit("\n"), "lower", rest).alias("full_text"))
    area = F.when(F.col("kind") == "signup", F.lit(6000.0)).otherwise(F.lit(3000.0))
    two = F.array(
        F.struct(F.lit(1).alias("line_key"), F.col("upper").alias("text"),
                 (F.col("value") * 3).alias("avg_y"), area.alias("avg_area")),
        F.struct(F.lit(2).alias("line_key"), F.col("lower").alias("text"),
                 F.lit(300.0).alias("avg_y"), F.lit(4000.0).alias("avg_area")),
    )
    placed = e.select("image_id", F.explode(two).alias("l")).select("image_id", F.lit(0).alias("part"), "l.*")
    return placed, texts


def stamps(t: Tables) -> DataFrame:
    """Position strings of all shapes with a range, one per event."""
    short, long = clock_times()
    kind = F.col("event_type")
    stamp = (
        F.when(kind == "click", short)
        .when(kind == "view", long)
        .when(kind == "error", F.minute("ts").cast("string"))
        .when(kind == "signup", F.lit(""))
    )
    stamp = F.when(kind == "purchase", F.concat(short, F.lit(":x"))).otherwise(stamp)
    size = F.floor("value").cast("int")
    return t.events.select(
        "event_id", stamp.alias("timestamp"), size.alias("size"),
        (-(size % 121)).alias("range_start"), (size % 97).alias("range_end"),
    )


# --- transcripts ----------------------------------------------------------------------


def utterances(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("clip_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text"
    )


def clip_items(t: Tables) -> DataFrame:
    return index_utterance_words(utterances(t))


def timed_words(t: Tables) -> DataFrame:
    words = clip_items(t).where(F.col("pos") >= 0)
    return words.select(
        F.col("clip_id").alias("episode_id"),
        "word_index",
        F.regexp_extract("item", r"\S+", 0).alias("text"),
        (F.col("word_index") * 400).cast("bigint").alias("start_ms"),
        (F.col("word_index") * 400 + 350).cast("bigint").alias("end_ms"),
        (F.lit(0.7) + F.col("word_index") % 7 * 0.05).alias("confidence"),
    )


def timings(t: Tables) -> DataFrame:
    """Word timings per clip that end before the last words do."""
    counts = (
        utterances(t)
        .where(F.col("speaker") != "system")
        .groupBy("clip_id")
        .agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("n"))
    )
    rows = counts.where("n > 0").select(
        "clip_id", F.explode(F.sequence(F.lit(0), (F.col("n") * 9 / 10).cast("int"))).alias("word_index")
    )
    return rows.select(
        "clip_id",
        "word_index",
        (F.col("word_index") * 400).cast("bigint").alias("start_ms"),
        (F.col("word_index") * 400 + 350).cast("bigint").alias("end_ms"),
    )


def selections(t: Tables) -> DataFrame:
    """The words of more than three characters of every clip, in runs of all lengths."""
    words = clip_items(t).where(F.col("pos") >= 0)
    return words.where(F.length(F.regexp_extract("item", r"\S+", 0)) > 3).select("clip_id", "word_index")


def clips(t: Tables) -> DataFrame:
    c = t.conversations.select(F.col("conv_id").alias("clip_id")).distinct()
    k = F.col("clip_id")
    return c.select(
        "clip_id",
        k.alias("episode_id"),
        F.concat((k % 3).cast("string"), F.lit(":"), F.lpad((k * 7 % 60).cast("string"), 2, "0")).alias("timestamp"),
        (k * 5 % 121).cast("int").alias("before_s"),
        (k * 11 % 121).cast("int").alias("after_s"),
    )


def _ranges(t: Tables, op: Column) -> DataFrame:
    start = F.floor("value").cast("int")
    reach = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("user_id").alias("clip_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        start.alias("from_index"),
        (start + reach).alias("to_index"),
    )


def range_events(t: Tables) -> DataFrame:
    removes = F.col("event_type").isin("click", "purchase")
    return _ranges(t, F.when(removes, "deselect").otherwise("select"))


def gesture_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return _ranges(
        t,
        F.when(kind == "click", "click").when(kind == "view", "drag")
        .when(kind == "error", "deselect").otherwise("select"),
    )


def files(t: Tables) -> DataFrame:
    """Uploads: four documents make a request."""
    k = F.col("doc_id")
    mime = F.when((F.col("lang") == "de") & (k % 7 == 0), "text/plain").otherwise("image/png")
    return t.documents.select(
        F.floor(k / 4).alias("request_id"), k.alias("image_id"), mime.alias("mime"),
        (F.col("n_chars") * 900).cast("bigint").alias("length"),
    )


def resolutions(t: Tables, *more: str) -> DataFrame:
    """Orders read as resolved screens, some fields missing; ``more`` columns of orders."""
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("image_id"),
        F.when(s != "F", F.col("o_custkey")).alias("podcast_id"),
        F.when(s != "F", F.concat(F.lit("Show "), F.col("o_custkey"))).otherwise("").alias("podcast_title"),
        F.when(s == "O", F.col("o_orderkey") * 3).alias("episode_id"),
        F.when(s == "O", F.concat(F.lit("Talk "), F.col("o_orderpriority"))).alias("episode_title"),
        F.date_format("o_orderdate", "d:MM").alias("timestamp"),
        (s == "O").alias("validated"),
        *more,
    )


def overrides(t: Tables) -> DataFrame:
    """Edits by orders of the customers' side: urgent ones replace, low ones delete."""
    p = F.col("o_orderpriority")
    return t.orders.where(p.isin("1-URGENT", "5-LOW")).select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_custkey") + 1).alias("podcast_id"),
        F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("Edited "), F.col("o_custkey"))).otherwise("").alias("podcast_title"),
        F.lit(None).cast("bigint").alias("episode_id"),
        F.when(F.col("o_totalprice") < 300000, F.lit("Edited talk")).alias("episode_title"),
        F.when(F.col("o_totalprice") < 100000, F.lit("9:59")).alias("timestamp"),
        (p == "5-LOW").alias("deleted"),
    )
