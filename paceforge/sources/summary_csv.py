"""Summary CSV exports whose header repeats names and may be English or French."""

from __future__ import annotations

import csv
import io
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field, accepted labels and which occurrence of the label holds it (fixed values).
FIELDS = {
    "activity_id": (("activity id", "id de l'activite"), 1),
    "activity_date": (("activity date", "date de l'activite"), 1),
    "name": (("activity name", "nom de l'activite"), 1),
    "provider_type": (("activity type", "type d'activite"), 1),
    "file_name": (("filename", "nom du fichier"), 1),
    "elapsed_s": (("elapsed time", "temps ecoule"), 2),
    "moving_s": (("moving time", "duree de deplacement"), 1),
    "distance_m": (("distance",), 2),
    "elevation_gain_m": (("elevation gain", "denivele positif"), 1),
    "elevation_loss_m": (("elevation loss", "denivele negatif"), 1),
}
#: Month names, English and French, without accents or points (fixed values).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "janv": 1, "fevr": 2, "mars": 3, "avr": 4, "mai": 5, "juin": 6, "juil": 7, "aout": 8, "sept": 9,
}
#: Activity kinds of the provider's labels (fixed values); all others are ``other``.
KINDS = {
    "run": "running",
    "trail run": "trail_running",
    "treadmill run": "treadmill_running",
    "virtual run": "treadmill_running",
    "course a pied": "running",
    "course sur sentier": "trail_running",
    "course sur tapis": "treadmill_running",
    "course virtuelle": "treadmill_running",
}
ACCENTS, PLAIN = "àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ’", "aaaeeeeiioouuucaaaeeeeiioouuuc'"


def plain_label(text: str) -> str:
    """A header label without accents, case and extra blanks."""
    folded = unicodedata.normalize("NFKD", text.replace("’", "'").lstrip("﻿"))
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).casefold().split())


def label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTS, PLAIN)), r"\s+", " "))


def header_positions(header: list[str]) -> dict[str, int] | None:
    """The position of each field, or None if one is missing."""
    labels, found = [plain_label(h) for h in header], {}
    for field, (names, occurrence) in FIELDS.items():
        at = [i for i, x in enumerate(labels) if x in names]
        if len(at) < occurrence:
            return None
        found[field] = at[occurrence - 1]
    return found


def timestamp(text: Column) -> Column:
    """ISO (without zone: UTC), ``Mon D, YYYY, h:mm:ss AM/PM`` or ``D month YYYY, HH:mm:ss``; null where it is none of them."""
    t = F.trim(text)
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    english, french = r"^([A-Za-z]{3}) (\d{1,2}), (\d{4}), (\d{1,2}):(\d{2}):(\d{2}) ([AaPp][Mm])$", r"^(\d{1,2}) (\S+) (\d{4}), (\d{1,2}):(\d{2}):(\d{2})$"
    e, f = (lambda i: F.regexp_extract(t, english, i)), (lambda i: F.regexp_extract(t, french, i))
    number = lambda x: x.try_cast("int")
    hour = number(e(4)) % 12 + F.when(F.upper(e(7)) == "PM", 12).otherwise(0)
    made = lambda y, mo, d, h, mi, s: F.try_make_timestamp(y, mo, d, h, mi, s, F.lit("UTC"))
    name = F.regexp_replace(label(f(2)), r"\.$", "")
    return F.coalesce(
        F.when(t.rlike(english), made(number(e(3)), month[F.lower(e(1))], number(e(2)), hour, number(e(5)), number(e(6)).cast("decimal(8,6)"))),
        F.when(t.rlike(french), made(number(f(3)), month[name], number(f(1)), number(f(4)), number(f(5)), number(f(6)).cast("decimal(8,6)"))),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp")),
    )


def number(text: Column) -> Column:
    """A number with or without thousands commas; null where it is blank or none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


RECORDS = "file string, row long, cells array<string>, at array<int>, width int"


def _records(batches):
    """Each file's records as arrays of cells, with the places of ``FIELDS`` that its own header tells; the header itself has null cells."""
    csv.field_size_limit(1 << 30)
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("width", pa.int32())])
    out: list[tuple] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    for batch in batches:
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
            header = next(reader, [])
            at = header_positions(header)
            places = None if at is None else [at[f] for f in FIELDS]
            out.append((file, 1, None, places, len(header)))
            for row, cells in enumerate(reader if at is not None else (), 2):
                out.append((file, row, cells, places, len(header)))
                if len(out) >= 5000:
                    yield batch_of()
                    out = []
    if out:
        yield batch_of()


def with_athlete(rows: DataFrame, athlete: str | Column | DataFrame) -> DataFrame:
    """Add ``athlete_id``: a literal, an expression over ``file``, or a table (file, athlete_id)."""
    if isinstance(athlete, DataFrame):
        return rows.join(athlete.select("file", F.col("athlete_id").cast("string").alias("athlete_id")), "file", "left")
    return rows.withColumn("athlete_id", F.lit(athlete).cast("string"))


def read_summary_csv(spark: SparkSession, path: str | list[str], athlete: str | Column | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(activities, findings) of all exports under ``path``, in one scan.

    Every file's header is resolved in the task that reads it, so languages and
    column orders may differ. Fields are taken by position, as names repeat. A
    row of another width or with an unreadable required value becomes a
    finding; the others go on. A header without the needed columns gives a
    single finding for its file and no rows. ``row`` counts records from 2.
    ``athlete`` tells whose export a file is (``with_athlete``).
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    records = with_athlete(files.mapInArrow(_records, RECORDS), athlete)
    col = {f: F.get("cells", F.get("at", F.lit(i))) for i, f in enumerate(FIELDS)}
    optional = ("moving_s", "distance_m", "elevation_gain_m", "elevation_loss_m")
    parsed = records.withColumns({"start_utc": timestamp(col["activity_date"]), "elapsed": number(col["elapsed_s"])})
    unreadable = reduce(lambda a, b: a | b, [~blank(col[f]) & number(col[f]).isNull() for f in optional])
    negative = reduce(lambda a, b: a | b, [F.coalesce(number(col[f]) < 0, F.lit(False)) for f in optional]) | F.coalesce(F.col("elapsed") < 0, F.lit(False))
    code = (
        F.when(F.col("row") == 1, F.when(F.col("at").isNull(), "STRAVA_HEADER_INVALID").otherwise("header"))
        .when(F.size("cells") != F.col("width"), "STRAVA_ROW_WIDTH_INVALID")
        .when(F.col("start_utc").isNull() | F.col("elapsed").isNull() | unreadable | negative | blank(col["activity_id"]), "STRAVA_ROW_INVALID")
    )
    marked = parsed.withColumn("code", code).where("code is null or code <> 'header'")
    text = lambda f: F.nullif(F.trim(col[f]), F.lit(""))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[label(col["provider_type"])], F.lit("other"))
    good = marked.where("code is null").select(
        "athlete_id", "row", text("activity_id").alias("activity_id"), kind.alias("kind"), F.trim(col["provider_type"]).alias("provider_type"), text("name").alias("name"),
        "start_utc", F.col("elapsed").alias("elapsed_s"), *[number(col[f]).alias(f) for f in optional], text("file_name").alias("file_name"), F.col("file").alias("export"),
    )
    message = F.when(F.col("code") == "STRAVA_HEADER_INVALID", "The export does not have the needed columns.").when(F.col("code") == "STRAVA_ROW_WIDTH_INVALID", "The row is not as wide as the header.").otherwise("The row could not be read.")
    return good, marked.where("code is not null").select(F.lit("error").alias("severity"), "code", message.alias("message"), F.when(F.col("row") > 1, F.col("row")).alias("row"), "athlete_id", F.col("file").alias("export"))
