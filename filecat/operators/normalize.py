"""Typed columns from the JSON that metadata extractors leave behind.

Of a list of keys the first that is there wins, even if its value is null or of the wrong type; so keys
are chosen among variants, where a JSON null is a value, and only then is the type tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecat.functions.columns import extractor_for, media_kind

EXTRACTOR_VERSION = "adapter-v1"


def chosen(payload: Column, paths: list[str]) -> Column:
    return F.coalesce(*(F.try_variant_get(payload, p, "variant") for p in paths))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f names it: inside lambdas Spark computes each mention anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _typed(v: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f of a variant, its kind and its text."""
    return _with(v, lambda x: _with(F.struct(_kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("text")), lambda t: f(x, t["kind"], t["text"])))


def _string(v: Column) -> Column:
    """Text that is not empty, or a number as text."""
    return _typed(v, lambda x, kind, text: F.when((kind == "STRING") & (text != ""), text).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), text))


def _text(v: Column) -> Column:
    """Text that is not blank, or a number as text."""
    return _with(_string(v), lambda text: F.when(text.rlike(r"(?U)\S"), text))  # white space of all of Unicode


def _long(v: Column) -> Column:
    """A JSON integer, or text that reads as one."""
    return _typed(v, lambda x, kind, text: F.when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint")).when((kind == "STRING") & text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")))


def _narrow(long: Column) -> Column:
    """A number within 32 bits."""
    return _with(long, lambda x: F.when(x.between(-(1 << 31), (1 << 31) - 1), x.cast("int")))


def _int(v: Column) -> Column:
    return _narrow(_long(v))


def _is_object(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT"))


def _double(v: Column) -> Column:
    return _typed(v, lambda x, kind, text: F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, "$", "double")).when((kind == "STRING") & text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")))


def _warnings(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(text)) for test, text in tests)), lambda w: w.isNotNull())


def normalize_exif(payloads: DataFrame) -> DataFrame:
    """node_id and typed columns of payloads (node_id, payload variant): an array whose first entry counts. Payloads of another shape have no row: they are failed records."""
    p = F.col("payload")
    at = lambda *keys: chosen(p, [f"$[0]['{k}']" for k in keys])
    rows = payloads.where(_is_object(F.try_variant_get(p, "$[0]", "variant"))).select(
        "node_id", _int(at("ImageWidth", "ExifImageWidth", "SourceImageWidth")).alias("width"), _int(at("ImageHeight", "ExifImageHeight", "SourceImageHeight")).alias("height"), _int(at("Orientation")).alias("orientation"),
        _text(at("DateTimeOriginal", "CreateDate", "MediaCreateDate")).alias("capture_text"), _text(at("Make")).alias("camera_make"), _text(at("Model")).alias("camera_model"),
        _double(at("GPSLatitude")).alias("lat"), _double(at("GPSLongitude")).alias("lon"), _text(at("ColorSpace", "ICC_Profile:ColorSpaceData")).alias("color_space"),
    )
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    warnings = _warnings(
        (F.col("width").isNull() | F.col("height").isNull(), "image dimensions are missing"), ((F.col("width") * F.col("height").cast("long")) == 0, "image dimensions are zero"),
        (F.col("lat").isNull() != F.col("lon").isNull(), "only one GPS coordinate is present"), (F.col("orientation").isNotNull() & ~F.col("orientation").between(1, 8), "orientation is outside the EXIF range 1 through 8"),
    )
    when = F.coalesce(*(F.try_to_timestamp("capture_text", F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss.S", "yyyy:MM:dd HH:mm:ssXXX", "yyyy:MM:dd HH:mm:ss.SXXX"))).cast("timestamp_ntz")
    return rows.select("node_id", "width", "height", "orientation", when.alias("capture_time"), "camera_make", "camera_model", F.when(both, F.col("lat")).alias("gps_latitude"), F.when(both, F.col("lon")).alias("gps_longitude"), "color_space", warnings.alias("warnings"))


def normalize_ffprobe(payloads: DataFrame) -> DataFrame:
    """node_id, container_format, duration_ms, total_bitrate, streams, warnings. What is no object among the streams is left out; a payload that is no object has no row."""
    p = F.col("payload")

    def ms(v: Column) -> Column:
        return _with(_double(v), lambda seconds: F.when((seconds >= 0) & (seconds < 9e15) & ~F.isnan(seconds), F.rint(seconds * 1000).cast("long")))

    streams = F.coalesce(F.try_variant_get(p, "$.streams", "array<variant>"), F.array().cast("array<variant>"))

    def stream(v: Column) -> Column:
        at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
        kind = F.try_variant_get(v, "$.codec_type", "string")
        return F.struct(
            F.coalesce(_int(at("index")), F.lit(0)).alias("stream_index"), F.when(kind.isin("video", "audio", "subtitle"), kind).otherwise("other").alias("stream_type"), F.coalesce(_string(at("codec_name")), F.lit("unknown")).alias("codec"),
            _int(at("width")).alias("width"), _int(at("height")).alias("height"), ms(at("duration")).alias("duration_ms"), _long(at("bit_rate")).alias("bitrate_bps"), _string(at("avg_frame_rate")).alias("frame_rate"), _string(at("tags.language")).alias("language"),
        )

    of = lambda k: F.try_variant_get(p, f"$.format.{k}", "variant")
    rows = payloads.where(_is_object(p)).select("node_id", _string(of("format_name")).alias("container_format"), ms(of("duration")).alias("duration_ms"), _long(of("bit_rate")).alias("total_bitrate"), F.transform(F.filter(streams, _is_object), stream).alias("streams"))
    return rows.withColumn("warnings", _warnings((F.size("streams") == 0, "ffprobe returned no media streams"), (F.col("duration_ms").isNull(), "container duration is missing")))


def first_video(streams: Column) -> Column:
    return F.get(F.filter(streams, lambda s: s["stream_type"] == "video"), F.lit(0))


def first_video_stream(probed: DataFrame) -> DataFrame:
    """node_id, width, height of the first stream of type video."""
    video = first_video(F.col("streams"))
    return probed.select("node_id", video["width"].alias("width"), video["height"].alias("height"))


def media_streams_from_probe(probed: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Rows of media_streams: those of the probed nodes are replaced, streams of other types dropped."""
    new = probed.select("node_id", F.explode("streams").alias("s")).select("node_id", "s.*").where("stream_type <> 'other'")
    if streams is None:
        return new
    return streams.join(probed.select("node_id"), "node_id", "left_anti").unionByName(new, allowMissingColumns=True)


def normalize_tika(payloads: DataFrame) -> DataFrame:
    """node_id, title, author, creation_date, modification_date, page_count, word_count, warnings of an object, or of the first of an array; other payloads have no row."""
    p = F.col("payload")
    is_array = lambda v: F.startswith(_kind(v), F.lit("ARRAY"))
    first_of = lambda v, test: F.get(F.filter(F.try_variant_get(v, "$", "array<variant>"), test), F.lit(0))

    def at(*keys: str) -> Column:
        return chosen(F.col("object"), [f"$['{k}']" for k in keys])

    def text(v: Column) -> Column:
        """As above, and of an array its first text, blank or not."""
        return F.when(is_array(v), F.try_variant_get(first_of(v, lambda x: _kind(x) == "STRING"), "$", "string")).otherwise(_text(v))

    def long(v: Column) -> Column:
        """As above, and of an array its first entry if that is text."""
        head = F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(0))
        return F.when(is_array(v), F.when(_kind(head) == "STRING", _long(head))).otherwise(_long(v))

    rows = payloads.withColumn("object", F.when(_is_object(p), p).otherwise(F.try_variant_get(p, "$[0]", "variant"))).where(_is_object(F.col("object")))
    rows = rows.select(
        "node_id", text(at("dc:title", "title")).alias("title"), text(at("dc:creator", "Author", "meta:author")).alias("author"), text(at("dcterms:created", "Creation-Date", "created")).alias("creation_date"),
        text(at("dcterms:modified", "Last-Modified", "modified")).alias("modification_date"), _narrow(long(at("xmpTPg:NPages", "meta:page-count"))).alias("page_count"), long(at("meta:word-count", "Word-Count")).alias("word_count"),
    )
    return rows.withColumn("warnings", _warnings((F.col("page_count") == 0, "document page count is zero"), (F.col("title").isNull() & F.col("author").isNull(), "document title and author are missing")))


def _identity() -> Column:
    return F.to_json(F.struct(F.col("mime_type").alias("mime"), F.col("byte_size").alias("size"), F.col("checksum_sha256").alias("checksum")))


def identity_record(files: DataFrame) -> DataFrame:
    """Rows of metadata_records for files (node_id, mime_type, byte_size, checksum_sha256), one each."""
    return files.select("node_id", F.lit("mime").alias("extractor_name"), F.lit("libmagic-v1").alias("extractor_version"), F.lit("completed").alias("status"), _identity().alias("raw_payload"), F.array().cast("array<string>").alias("warnings"))


def generic_record(files: DataFrame) -> DataFrame:
    """Records of files that no extractor reads: they keep what identifies the file."""
    rows = files.where(extractor_for("mime_type") == "generic")
    return rows.select("node_id", F.lit("generic").alias("extractor_name"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit("unsupported").alias("status"), _identity().alias("raw_payload"), F.array(F.lit("no specialized extractor supports this MIME type")).alias("warnings"))


def parsed_records(payloads: DataFrame) -> DataFrame:
    """payloads (node_id, extractor_name, raw) with payload and status; what is no JSON becomes a failed record with its error."""
    parsed = F.try_parse_json("raw")
    bad = parsed.isNull()
    return payloads.select("node_id", "extractor_name", parsed.alias("payload"), F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, F.lit('{"error":"payload is not JSON"}')).otherwise(F.col("raw")).alias("raw_payload"), F.when(bad, F.array(F.lit("payload is not JSON"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def node_metadata(objects: DataFrame, exif: DataFrame, probe: DataFrame, tika: DataFrame) -> DataFrame:
    """One row for each finalized object: its MIME and kind, and the columns of the extractor for that kind."""
    base = objects.where("upload_state = 'finalized'").select("node_id", F.col("mime_type").alias("detected_mime"), media_kind("mime_type").alias("media_kind"))
    image = exif.select("node_id", *(F.col(c).alias(f"e_{c}") for c in ("width", "height", "orientation", "capture_time", "camera_make", "camera_model", "gps_latitude", "gps_longitude")))
    stream = first_video(F.col("streams"))
    video = probe.select("node_id", stream["width"].alias("p_width"), stream["height"].alias("p_height"), F.col("duration_ms").alias("p_duration"))
    document = tika.select("node_id", "title", "author", "page_count", F.try_to_timestamp("creation_date").cast("timestamp_ntz").alias("document_created_at"), F.try_to_timestamp("modification_date").cast("timestamp_ntz").alias("document_modified_at"))
    rows = base.join(image, "node_id", "left").join(video, "node_id", "left").join(document, "node_id", "left")
    is_, media = (lambda k: F.col("media_kind") == k), F.col("media_kind").isin("video", "audio")
    return rows.select(
        "node_id", "detected_mime", "media_kind", F.when(media, F.col("p_duration")).alias("duration_ms"), F.when(is_("image"), F.col("e_width")).when(media, F.col("p_width")).alias("width"), F.when(is_("image"), F.col("e_height")).when(media, F.col("p_height")).alias("height"),
        F.when(is_("image"), F.col("e_capture_time")).alias("capture_time"), F.when(is_("document"), F.col("page_count")).alias("page_count"), F.when(is_("image"), F.col("e_orientation")).alias("orientation"), F.coalesce(is_("image") & F.col("e_gps_latitude").isNotNull(), F.lit(False)).alias("has_gps"),
        F.when(is_("image"), F.col("e_gps_latitude")).alias("gps_latitude"), F.when(is_("image"), F.col("e_gps_longitude")).alias("gps_longitude"), F.when(is_("image"), F.col("e_camera_make")).alias("camera_make"), F.when(is_("image"), F.col("e_camera_model")).alias("camera_model"),
        F.when(is_("document"), F.col("title")).alias("document_title"), F.when(is_("document"), F.col("author")).alias("document_author"), F.when(is_("document"), F.col("document_created_at")).alias("document_created_at"), F.when(is_("document"), F.col("document_modified_at")).alias("document_modified_at"),
    )
