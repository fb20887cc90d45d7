"""Fixed schemas of the input and output tables."""

OCR_ANNOTATIONS = (
    "image_id string, textAnnotations array<struct<description: string, "
    "boundingPoly: struct<vertices: array<struct<x: int, y: int>>>>>"
)
#: Holds the text of a line that could not be read.
BAD_LINE = "_corrupt_record"
PODCASTS = (
    "podcast_id bigint, title string, artist string, feed_url string, artwork_100 string, "
    "artwork_600 string, description string, genres array<string>"
)
EPISODES = (
    "podcast_id bigint, episode_id bigint, title string, description string, duration_ms bigint, "
    "artwork_100 string, artwork_600 string, release_date timestamp"
)
FEED_XML = (
    "channel array<struct<item: array<struct<title: array<string>, "
    "enclosure: array<struct<_url: string, _type: string, _length: string>>>>>>"
)
TRANSCRIPT_RESULTS = (
    "clip_id string, text string, confidence double, "
    "words array<struct<text: string, start: bigint, end: bigint, confidence: double>>, "
    "utterances array<struct<speaker: string, text: string>>"
)
