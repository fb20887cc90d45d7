"""Selections, speaker text, blocks, quotes, clip slices, feeds, edits, readers, streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cueglass import schemas
from cueglass.config import Limits
from cueglass.functions.screen import SYSTEM_PHRASES
from cueglass.functions.text import PLAIN_STOP_WORDS, RANKED_STOP_WORDS
from cueglass.operators import catalog, edits, selection, transcript
from cueglass.operators.scale import cut, free, previous_value, running_total, skew_join
from cueglass.plans import clips, quotes, resolve
from cueglass.sources import readers, writers
from cueglass.streaming import jobs

UTTERANCE = "clip_id string, seq int, speaker string, text string"


def test_speaker_text_and_blocks(spark):
    u = spark.createDataFrame(
        [("c", 0, "A", "Hi there."), ("c", 1, "A", "All well?"), ("c", 2, "B", "Yes.")], UTTERANCE
    )
    assert transcript.speaker_text(u).first().text == "Hi there. All well?\n\nYes."
    picked = spark.createDataFrame([("c", i) for i in (0, 1, 3, 4, 77)], "clip_id string, word_index int")
    got = quotes.block_texts(transcript.index_utterance_words(u), picked).orderBy("start_index").collect()
    assert [(r.start_index, r.end_index, r.text) for r in got] == [
        (0, 1, "Hi there."), (3, 4, "well?\n\nYes.")
    ]


def test_utterance_words_equal_words_of_whole_text(spark):
    rng = random.Random(4)
    rows = []
    for clip in "abc":
        for seq in range(60):
            text = "".join(rng.choice(["w", "xy ", " ", "\n", "z"]) for _ in range(rng.randint(0, 9)))
            rows.append((clip, seq, rng.choice("AB"), text))
    u = spark.createDataFrame(rows, UTTERANCE)
    limits = Limits(running_chunk=7)
    items = transcript.index_utterance_words(u, limits).where("pos >= 0").collect()
    got = sorted((r.clip_id, r.word_index, r.item.strip()) for r in items)
    whole = {r.clip_id: r.text for r in transcript.speaker_text(u, limits).collect()}
    assert got == sorted((c, i, w) for c, t in whole.items() for i, w in enumerate(t.split()))
    # Blocks over everything give back the whole text.
    every = spark.createDataFrame([(c, i) for c, i, _ in got], "clip_id string, word_index int")
    blocks = quotes.block_texts(transcript.index_utterance_words(u, limits), every, limits).collect()
    assert {r.clip_id: r.text for r in blocks} == {c: t.strip() for c, t in whole.items()}


def test_single_speaker_keeps_plain_text(spark):
    u = spark.createDataFrame([("c", 0, "A", "one"), ("c", 1, "A", "two")], UTTERANCE)
    t = spark.createDataFrame([("c", "One, two."), ("d", "None.")], "clip_id string, text string")
    assert {r.clip_id: r.text for r in transcript.format_transcripts(t, u).collect()} == {
        "c": "One, two.", "d": "None."
    }
    items = transcript.index_transcripts(t, u).collect()
    assert sorted((r.clip_id, r.word_index, r.item) for r in items) == [
        ("c", 0, "One, "), ("c", 1, "two."), ("d", 0, "None.")
    ]


def test_chunked_windows_match_plain_ones(spark):
    rng = random.Random(9)
    rows = [("g%d" % rng.randint(0, 2), n, rng.randint(0, 5)) for n in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    total = running_total(df, "g", "o", "v", "t", chunk=13).collect()
    before = previous_value(df, "g", "o", "v", "p", chunk=13).collect()
    for name, got in (("t", total), ("p", before)):
        for r in got:
            earlier = sorted((o, v) for g, o, v in rows if g == r.g and o < r.o)
            want = sum(v for _, v in earlier) if name == "t" else (earlier[-1][1] if earlier else None)
            assert r[name] == want


def test_skew_join_equals_plain_join(spark):
    many = spark.createDataFrame([(i % 3 and 0 or i % 7, i) for i in range(300)], "k int, a int")
    few = spark.createDataFrame([(i % 5, i) for i in range(40)], "k int, b int")
    plain = sorted(map(tuple, many.join(few, "k").select("a", "b").collect()))
    split = skew_join(many, few, ["k"], Limits(hot_pairs=50))
    assert sorted(map(tuple, split.select("a", "b").collect())) == plain


@pytest.mark.parametrize(
    "events,expected",
    [
        ([("click", 3, None)], [3]),
        ([("click", 3, None), ("click", 3, None)], []),
        ([("select", 1, 5), ("click", 3, None)], [1, 2, 3]),
        ([("drag", 2, 4)], [2, 3, 4]),
        ([("drag", 2, 2)], []),
        ([("select", 0, 2), ("select", 4, 6), ("drag", 2, 5)], [0, 1, 4, 5, 6]),
        ([("select", 5, 1), ("deselect", 3, 2)], [1, 4, 5]),
    ],
)
def test_event_fold(spark, events, expected):
    schema = "clip_id string, seq bigint, op string, from_index int, to_index int"
    rows = [("c", i, *e) for i, e in enumerate(events)] + [("d", 0, "click", 9, None)]
    got = selection.fold_events(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.word_index for r in got if r.clip_id == "c") == expected
    assert [r.word_index for r in got if r.clip_id == "d"] == [9]


def test_range_events_need_no_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice(["select", "deselect"]), rng.randint(0, 30), rng.randint(0, 30))
            for i in range(60)]
    df = spark.createDataFrame(rows, "clip_id string, seq bigint, op string, from_index int, to_index int")
    fold = sorted(map(tuple, selection.fold_events(df).collect()))
    assert sorted(map(tuple, selection.latest_ranges(df).collect())) == fold
    blocks = selection.selection_blocks(selection.fold_events(df)).collect()
    covered = sorted((r.clip_id, i) for r in blocks for i in range(r.start_index, r.end_index + 1))
    assert covered == fold


def test_runs_equal_a_set_of_words():
    """The interval set against the rules written for a plain set of words."""

    def plain(selected, op, start, end):
        first = last = start
        while first - 1 in selected:
            first -= 1
        while last + 1 in selected:
            last += 1
        if op == "click":
            if start not in selected:
                selected.add(start)
            elif first == last:
                selected.discard(start)
            else:
                selected.difference_update(range(start + 1, last + 1))
            return
        end = start if end is None else end
        low, high = min(start, end), max(start, end)
        if op == "select" or (op == "drag" and start != end and start not in selected):
            selected.update(range(low, high + 1))
        elif op == "deselect":
            selected.difference_update(range(low, high + 1))
        elif op == "drag" and start != end:
            selected.difference_update(range(max(low, first), min(high, last) + 1))

    rng = random.Random(11)
    for _ in range(200):
        runs, words = selection.Runs(), set()
        for _ in range(40):
            event = rng.choice(["click", "drag", "select", "deselect"]), rng.randrange(25), rng.choice([None, rng.randrange(25)])
            selection.apply_event(runs, *event)
            plain(words, *event)
            assert [w for a, b in zip(runs.starts, runs.ends) for w in range(a, b + 1)] == sorted(words)
            assert all(b + 1 < a for b, a in zip(runs.ends, runs.starts[1:]))


def test_a_drag_over_ten_million_words_is_one_run():
    runs = selection.Runs()
    selection.apply_event(runs, "drag", 0, 10_000_000)
    selection.apply_event(runs, "click", 5_000_000, None)
    assert (runs.starts, runs.ends) == ([0], [5_000_000])


EVENT = "clip_id string, seq bigint, op string, from_index int, to_index int"


@pytest.mark.parametrize("chunk", [2, 8, 4096])
def test_latest_intervals_equal_the_fold(spark, chunk):
    """Small chunks, so that blocks above them, chunk borders and carried values occur."""
    rng = random.Random(chunk)
    rows = [(rng.choice("aab"), i, rng.choice(["select", "deselect"]), rng.randint(0, 300), rng.choice([None, rng.randint(0, 300)]))
            for i in range(150)]
    rows += [("c", 0, "deselect", 1, 9), ("d", 0, "select", 4, None), (None, 1, "select", 1, 2), ("d", 1, "select", None, 3)]
    df = spark.createDataFrame(rows, EVENT)
    want = sorted(map(tuple, selection.fold_intervals(df.where("clip_id IS NOT NULL AND from_index IS NOT NULL")).collect()))
    got = selection.latest_intervals(df, Limits(running_chunk=chunk))
    assert sorted(map(tuple, got.collect())) == want
    words = spark.createDataFrame([(c, w, "x") for c in "abd" for w in range(0, 300, 3)] * 2, "clip_id string, word_index int, t string")
    chosen = selection.latest_words(df, words, Limits(running_chunk=chunk))
    inside = sorted((c, w, "x") for c in "abd" for w in range(0, 300, 3) if any(k == c and a <= w <= b for k, a, b in want))
    assert sorted(map(tuple, chosen.collect())) == sorted(inside * 2)


def test_a_range_of_a_billion_words(spark):
    rows = [("c", 0, "select", 0, 1_000_000_000), ("c", 1, "deselect", 10, 20), ("c", 2, "select", 15, 15)]
    df = spark.createDataFrame(rows, EVENT)
    got = sorted((r.start_index, r.end_index) for r in selection.latest_intervals(df).collect())
    assert got == [(0, 9), (15, 15), (21, 1_000_000_000)]
    assert selection.latest_intervals(df.limit(0)).collect() == []


def test_selected_words_are_never_broadcast(spark, capsys):
    """Rows made from ranges or texts are more than Spark expects, and would fill the driver."""
    events = spark.createDataFrame(
        [(1, 1, "select", 2, 9), (1, 2, "deselect", 4, 5)],
        "clip_id bigint, seq bigint, op string, from_index int, to_index int",
    )
    words = spark.range(12).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("word_index"))
    found = selection.latest_words(events, words)
    found.explain()
    assert sorted(r.word_index for r in found.collect()) == [2, 3, 6, 7, 8, 9]
    assert "Broadcast" not in capsys.readouterr().out


def test_stream_of_events(spark, tmp_path):
    schema = "clip_id string, seq bigint, op string, from_index int, to_index int"
    spark.createDataFrame([("c", 0, "select", 0, 4), ("c", 1, "click", 2, None), ("d", 0, "click", 1, None)],
                          schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    run = jobs.stream_selections(stream).writeStream.format("memory").queryName("chosen")
    run = run.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    spark.createDataFrame([("c", 1, "click", 2, None), ("c", 2, "click", 1, None)], schema).coalesce(1).write.mode(
        "append").json(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    rows = sorted((r.clip_id, r.seq, list(r.word_indexes)) for r in spark.table("chosen").collect())
    assert rows == [("c", 1, [0, 1, 2]), ("c", 2, [0, 1]), ("d", 0, [1])]


def test_stream_equals_fold_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    schema = "clip_id string, seq bigint, op string, from_index int, to_index int"
    events = [
        (rng.choice("ab"), seq, rng.choice(["click", "drag", "select", "deselect"]), rng.randrange(20),
         rng.choice([None, rng.randrange(20)]))
        for seq in range(60)
    ]
    shuffled = rng.sample(events, len(events)) + events[:5]  # some come twice
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    last = {}
    for i in range(0, len(shuffled), 22):
        part = spark.createDataFrame(shuffled[i : i + 22], schema)
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run = jobs.stream_selections(stream).writeStream.outputMode("update").foreachBatch(
            lambda df, _: last.update({r.clip_id: sorted(r.word_indexes) for r in df.collect()})
        )
        started = run.option("checkpointLocation", str(tmp_path / "cp")).start()
        started.processAllAvailable()
        started.stop()
    folded = selection.fold_events(spark.createDataFrame(events, schema)).collect()
    expected = {c: sorted(r.word_index for r in folded if r.clip_id == c) for c in "ab"}
    assert last == expected


def test_stream_candidates(spark, tmp_path):
    box = lambda x, y, w: {"vertices": [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + 60}]}
    words = [("Hidden", 0), ("Brain", 400), ("Weekly", 800)]
    annotation = {"image_id": "i", "textAnnotations": [{"description": "Hidden Brain Weekly"}] + [
        {"description": w, "boundingPoly": box(x, 500, 120)} for w, x in words]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(annotation))
    stream = spark.readStream.schema(schemas.OCR_ANNOTATIONS).json(str(tmp_path / "in"))
    screens = spark.createDataFrame([("i", 1000)], "image_id string, height int")
    run = jobs.stream_candidates(stream, screens, str(tmp_path / "out"))
    started = run.option("checkpointLocation", str(tmp_path / "cp")).start()
    started.processAllAvailable()
    started.stop()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Hidden Brain Weekly"]


def test_quote_text(spark, tmp_path):
    u = spark.createDataFrame([("c", 0, "A", "Hi there."), ("c", 1, "B", "All well?")], UTTERANCE)
    items = transcript.index_utterance_words(u)
    clip = spark.createDataFrame(
        [("c", "Pilot", "", 7, 9, "0:10", -30, 15, "old"), ("e", "Empty", "x", 1, 2, "0:10", 0, 0, "old")],
        "clip_id string, episode_title string, podcast_name string, podcast_id bigint, episode_id bigint, "
        "timestamp string, range_start int, range_end int, stored_label string",
    )
    picked = spark.createDataFrame([("c", 1), ("c", 3)], "clip_id string, word_index int")
    times = spark.createDataFrame(
        [("c", i, 61500 + i * 1000, 62400 + i * 1000) for i in range(4)],
        "clip_id string, word_index int, start_ms bigint, end_ms bigint",
    )
    head = "Unknown Podcast\nhttps://podcasts.apple.com/podcast/id7?i=9"
    got = quotes.export_quotes(clip, items, picked, times).collect()
    assert [r.quote for r in got] == [f"Pilot (1:02-1:06)\n{head}&t=62\n\nthere.\n\nwell?"]
    bare = quotes.export_quotes(clip, items, picked, times.where("word_index < 3")).first().quote
    assert bare == f"Pilot (0:00-0:25)\n{head}&t=62\n\nthere.\n\nwell?"
    both = spark.createDataFrame([("r", 1, "B"), ("r", 0, "A")], "request_id string, file_index int, quote string")
    assert quotes.export_requests(both).first().text == "A\n\n\nB"
    writers.write_quotes(quotes.export_quotes(clip, items, picked, times), str(tmp_path / "q"))
    assert "there." in "".join(r.value for r in spark.read.text(str(tmp_path / "q")).collect())


def test_transcript_words_are_never_broadcast(spark, capsys):
    spoken = spark.createDataFrame([(1, 0, "a", "one two"), (1, 1, "b", "three four")], "clip_id bigint, seq int, speaker string, text string")
    items = transcript.index_utterance_words(spoken)
    times = spark.range(3).selectExpr("1L AS clip_id", "int(id) AS word_index", "id AS start_ms", "id + 1 AS end_ms")
    aligned = transcript.align_timings(items, times)
    blocks = quotes.block_texts(items, spark.range(1, 3).selectExpr("1L AS clip_id", "int(id) AS word_index"))
    aligned.explain()
    blocks.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert [r.start_ms for r in aligned.where("pos >= 0").orderBy("word_index").collect()] == [0, 1, 2, None]
    assert [r.text for r in blocks.collect()] == ["two\n\nthree"]


def test_clip_words_and_transcripts(spark):
    asked = spark.createDataFrame(
        [("k1", 1, 11, "Pilot", "0:10", 5, 5), ("k2", 1, 11, "Pilot", "", 5, 5), ("k3", 2, 12, "Zzz", "0:10", 5, 5)],
        "clip_id string, podcast_id bigint, episode_id bigint, episode_title string, timestamp string, "
        "before_s int, after_s int",
    )
    timed = spark.createDataFrame(
        [(11, i, f"w{i}", i * 1000, i * 1000 + 500, 0.9) for i in range(30)],
        "episode_id bigint, word_index int, text string, start_ms bigint, end_ms bigint, confidence double",
    )
    cut_out = clips.clip_words(asked.where("clip_id = 'k1'"), timed, Limits(range_bucket_ms=4000)).collect()
    assert sorted((r.word_index, r.text) for r in cut_out) == [(i, f"w{i + 5}") for i in range(10)]
    items = spark.createDataFrame(
        [(1, 0, "The Pilot", "http://a/1.mp3", None, ""), (1, 1, "Pilot", "http://a/2.mp3", "audio/mpeg", "5")],
        "podcast_id bigint, pos int, title string, url string, type string, length string",
    )
    got = {r.clip_id: r for r in clips.clip_transcripts(asked, items, timed).collect()}
    assert got["k1"].source == "assemblyai" and got["k1"].transcript.split() == [f"w{i}" for i in range(5, 15)]
    assert got["k1"].audio_url == "http://a/1.mp3"  # the first item above the threshold, not the best
    assert (got["k2"].source, got["k2"].mock_reason) == ("mock", "AssemblyAI generation failed")
    assert (got["k3"].source, got["k3"].mock_reason) == ("mock", "Audio URL not available")


def test_a_window_is_cut_out_once(spark, monkeypatch):
    """Two titles asked for one window share its words; an id that comes twice has both windows."""
    rows = [("k1", 1, 11, "Pilot", "0:10", 5, 5), ("k2", 1, 11, "The Pilot", "0:10", 5, 5)]
    rows += [("k3", 1, 11, "Pilot", "0:03", 1, 1), ("k3", 1, 11, "Pilot", "0:10", 5, 5)]
    asked = spark.createDataFrame(
        rows, "clip_id string, podcast_id bigint, episode_id bigint, episode_title string, timestamp string, "
        "before_s int, after_s int",
    )
    timed = spark.range(30).selectExpr(
        "11L AS episode_id", "int(id) AS word_index", "concat('w', id) AS text", "id * 1000 AS start_ms",
        "id * 1000 + 500 AS end_ms", "0.9D AS confidence",
    )
    items = spark.createDataFrame(
        [(1, 0, "The Pilot", "http://a/1.mp3", None, "")],
        "podcast_id bigint, pos int, title string, url string, type string, length string",
    )
    cut_out, slice_clips = [], clips.slice_clips
    monkeypatch.setattr(clips, "slice_clips", lambda spans, *rest: cut_out.append(spans) or slice_clips(spans, *rest))
    got = {(r.clip_id, r.timestamp): r.transcript for r in clips.clip_transcripts(asked, items, timed).collect()}
    assert cut_out[0].count() == 3
    assert got["k1", "0:10"] == got["k2", "0:10"] == " ".join(f"w{i}" for i in range(5, 15))
    assert got["k3", "0:03"] == got["k3", "0:10"] == " ".join(f"w{i}" for i in [2, 3, *range(5, 15)])


def test_feed_parsing_and_odd_titles(spark):
    xml = (
        "<rss><channel><title>x</title><item><title>日本</title></item>"
        '<item><title>Episode One</title><enclosure url="http://a/1" type="audio/mpeg" length="9"/></item>'
        "</channel></rss>"
    )
    feeds = spark.createDataFrame([(1, xml), (2, "not xml at all"), (3, xml.replace("日本", "B"))],
                                  "podcast_id bigint, xml string")
    items = readers.feed_items(feeds)
    assert sorted((r.podcast_id, r.pos, r.title) for r in items.collect()) == [
        (1, 0, "日本"), (1, 1, "Episode One"), (3, 0, "B"), (3, 1, "Episode One")
    ]
    asked = spark.createDataFrame([(1, "episode one"), (1, "中"), (3, "episode one"), (3, "ab")],
                                  "podcast_id bigint, term string")
    got = {(r.podcast_id, r.term): r.title for r in readers.first_similar_items(asked, items).collect()}
    # A title without letters counts as contained in any text, as does one letter.
    assert got == {(1, "episode one"): "日本", (1, "中"): "日本", (3, "episode one"): "Episode One",
                   (3, "ab"): "B"}


def test_overrides_and_deletes(spark):
    schema = ("image_id string, podcast_id bigint, podcast_title string, episode_id bigint, "
              "episode_title string, timestamp string")
    r = spark.createDataFrame([("a", 1, "P", 2, "E", "1:00"), ("b", 3, "Q", 4, "F", "2:00")], schema)
    o = spark.createDataFrame([("a", 9, "New", None, "", None, False), ("b", None, None, None, None, None, True)],
                              schema + ", deleted boolean")
    got = {x.image_id: tuple(x)[1:] for x in edits.apply_overrides(r, o).collect()}
    assert got["a"] == (9, "New", 2, "E", "1:00")
    assert [x.image_id for x in edits.drop_deleted(r, o).collect()] == ["a"]


def test_readers(spark, tmp_path):
    box = lambda x, y, w, h: {"vertices": [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"y": y}]}
    rows = [{"image_id": "a", "textAnnotations": [{"description": "Hi you"},
             {"description": "Hi", "boundingPoly": box(1, 2, 10, 5)}, {"description": "you", "boundingPoly": box(20, 2, 15, 5)}]},
            {"image_id": "b", "textAnnotations": []}]
    (tmp_path / "ocr.json").write_text("\n".join(json.dumps(r) for r in rows))
    found = readers.read_ocr(spark, str(tmp_path / "ocr.json"))
    assert [tuple(r) for r in readers.ocr_texts(found).collect()] == [("a", "Hi you")]
    got = readers.ocr_words(found).orderBy("word_idx").collect()
    assert [(r.word_idx, r.text, r.x0, r.y0, r.x1, r.y2) for r in got] == [(0, "Hi", 1, 2, 11, 7), (1, "you", 20, 2, 35, 7)]

    result = [{"clip_id": "c", "words": [{"text": "a", "start": 5, "end": 9, "confidence": 0.5}]}, {"clip_id": "d"}]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in result))
    results = readers.read_transcript_results(spark, str(tmp_path / "t.json"))
    assert {r.clip_id: (r.text, r.confidence, len(r.words)) for r in results.collect()} == {"c": ("", 0.0, 1), "d": ("", 0.0, 0)}
    assert [tuple(r) for r in readers.transcript_words(results).collect()] == [("c", 0, "a", 5, 9, 0.5)]


def test_upload_limits(spark):
    mb = 1024 * 1024
    rows = [("ok", "image/png", 6 * mb), ("ok", "image/png", mb), ("big", "image/png", 11 * mb), ("big", "image/png", 1),
            ("pdf", "application/pdf", 1)] + [("many", "image/png", 1)] * 6
    df = spark.createDataFrame(rows, "request_id string, mime string, length bigint")
    got = sorted((r.request_id, r.size_mb, r.is_large) for r in readers.accept_requests(df).collect())
    assert got == [("ok", 1.0, False), ("ok", 6.0, True)]


def test_corrections(spark):
    df = spark.createDataFrame([("c", {"names": 2, "flow": 0}), ("d", {"names": 0})], "k string, improvements map<string,int>")
    got = {tuple(r) for r in transcript.unpivot_improvements(df, "k").collect()}
    assert got == {("c", False, "names", 2), ("d", True, None, None)}
    items = spark.createDataFrame([("c", ['{"original":"a","corrected":"b","confidence":0.5}', "plain", "{}"])], "k string, items array<string>")
    got = [tuple(r)[2:] for r in transcript.correction_items(items, "k").orderBy("pos").collect()]
    assert got == [("a", "b", None, 0.5), (None, None, "plain", None),
                   (None, None, "Correction applied (details not available)", None)]
    status = edits.status_counts(df.withColumn("error", F.when(F.col("k") == "c", "bad"))).first()
    assert tuple(status) == (2, 1, 1)


def test_bad_ocr_lines_become_error_rows(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"image_id": "a", "textAnnotations": []}\n{broken\n{"textAnnotations": []}\n')
    found = readers.read_ocr(spark, str(tmp_path / "o.json"))
    rows = sorted((r.error, r.raw_text) for r in readers.ocr_errors(found).collect())
    assert rows == [("OCR result without image", None), ("Unreadable OCR result", "{broken")]


def test_catalog_and_image_files(spark, tmp_path):
    pods = [(1, " A\u00a0b ", None, None, "s", "l", None, None)]
    spark.createDataFrame(pods, schemas.PODCASTS).write.parquet(str(tmp_path / "p"))
    eps = [(1, 2, " E ", "d", 5, "", "l", None)]
    spark.createDataFrame(eps, schemas.EPISODES).write.parquet(str(tmp_path / "e"))
    podcasts, found = readers.read_podcasts(spark, str(tmp_path / "p")), readers.read_episodes(spark, str(tmp_path / "e"))
    assert [r.title for r in podcasts.collect()] == ["A b"]
    listed = catalog.episode_listing(found).first().listing[0]
    assert (listed.title, listed.description, listed.duration_ms, listed.artwork_url) == ("E", "d", 5, "l")
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.PNG").write_bytes(b"abc")
    (tmp_path / "i" / "y.txt").write_bytes(b"abcd")
    files = readers.read_image_files(spark, str(tmp_path / "i")).collect()
    assert sorted((r.mime, r.length) for r in files) == [("image/png", 3), ("other", 4)]


def test_records_and_writers(spark, tmp_path):
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    resolved = spark.createDataFrame(
        [("a", 1, "P", 0.9, 2, "E", 0.8)],
        "image_id string, podcast_id bigint, podcast_title string, podcast_confidence double, "
        "episode_id bigint, episode_title string, episode_confidence double")
    texts = spark.createDataFrame([("a", "P E")], "image_id string, full_text string")
    times = spark.createDataFrame([("a", "1:00")], "image_id string, timestamp string")
    lists = spark.createDataFrame([("a", ["P"])], "image_id string, candidates array<string>")
    podcasts = spark.createDataFrame([(1, "", "big")], "podcast_id bigint, artwork_100 string, artwork_600 string")
    records = resolve.extraction_records(images, texts, times, lists, resolved, podcasts)
    writers.write_resolutions(records, str(tmp_path / "r"))
    a, b = spark.read.parquet(str(tmp_path / "r")).orderBy("image_id").collect()
    assert tuple(a.validated_podcast) == (1, "P", "big", 0.9) and tuple(a.validated_episode) == (2, "E", None, 0.8)
    assert (b.validated_podcast, b.error) == (None, "No text detected in image")
    writers.write_transcripts(times, str(tmp_path / "t"), "json")
    assert spark.read.json(str(tmp_path / "t")).count() == 1


def test_word_lists():
    for word in ("the", "with", "and"):
        assert word in RANKED_STOP_WORDS and word in PLAIN_STOP_WORDS
    for word in ("podcast", "hidden", "news", ""):
        assert word not in PLAIN_STOP_WORDS
    assert "hidden" not in RANKED_STOP_WORDS
    assert len(SYSTEM_PHRASES) == len(set(SYSTEM_PHRASES)) and all(p == p.lower() for p in SYSTEM_PHRASES)


def test_feeds_and_requests_move_once(spark):
    """Both ways find the same items; small feeds need one shuffle, and no request is lost."""
    parts = ["ab", "abc", "abcd", "x", "xy", "Talk", "talks", "ab ab", "", "日本", "on-air", "!"]
    texts = [(k % 4, " ".join(parts[(k * 7 + i * i) % 12] for i in range(1 + k % 4))) for k in range(80)]
    asked = spark.createDataFrame([*texts[:40], *texts[:3], (9, "ab"), (None, "ab"), (1, None)], "podcast_id int, term string")
    items = spark.createDataFrame(
        [(p, i, title, f"u{i}", None, "") for i, (p, title) in enumerate(texts[25:])],
        "podcast_id int, pos int, title string, url string, type string, length string",
    )
    small = readers.first_similar_items(asked, items)
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted(map(tuple, small.collect()), key=str)
    large = readers.first_similar_items(asked, items, Limits(hot_pairs=1))
    assert got == sorted(map(tuple, large.collect()), key=str) and len(got) > 8
    every = {(r.podcast_id, r.term): r.audio_url for r in readers.audio_urls(asked, items).collect()}
    assert set(every) == {tuple(r) for r in asked.collect()}
    assert {k: v for k, v in every.items() if v} == {(r[0], r[1]): r[4] for r in got}


def test_stored_tables_leave_no_shuffle_files(spark):
    """What was shuffled for a stored table goes with its query, and the table when it is freed."""
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    before = shuffled()
    stored = cut(spark.range(1000).repartition(4, "id"))
    until = time.time() + 10
    while shuffled() > before and time.time() < until:
        time.sleep(0.1)
    assert shuffled() <= before and stored.count() == 1000
    free(stored)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(stored._cut_to)
