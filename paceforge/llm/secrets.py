"""Secret scans with multipart credential linking, in DataFrame functions only.

Every pattern gives spans of the whole text. Passwords, access identifiers and
hex keys are reported on sight. Logins, opaque strings and endpoints are weak:
they are reported only if parts of the other roles lie in the same scope, that
is, at most ``scope`` code points away. The scope is an interval join of the
spans by text and bucket of positions; spans of one kind do not overlap, so a
bucket holds a bounded number of them and the join stays linear. Equal texts
are joined once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle


@dataclass(frozen=True)
class Kind:
    """A kind of span: its role, its pattern, which group must have how many characters, and whether it needs partners."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    weak: bool = False


#: In the order in which kinds are listed at one start.
KINDS = (
    Kind("assign", "secret", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", "secret", r"[0-9a-f]{24,}"),
    Kind("login", "identifier", r"(?i)(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 1, 3, True),
    Kind("opaque", "secret", r"[A-Za-z0-9+/]{40,}={0,2}", weak=True),
    Kind("endpoint", "endpoint", r"(?i)https?://[^\x00-\x20\"'<>]+", weak=True),
)
#: The roles that must be near a weak span of a role.
PARTNERS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
SCOPE = 200
#: Matches whose positions are summed in one go; sums of such runs are summed in turn.
RUN = 256
SPAN = "array<struct<start:int,end:int>>"


def _running(items: Column) -> Column:
    """[(before, length)] to [(start, end)] by a running sum from 0."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        end = start + x["length"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(items, first, step, lambda acc: acc["out"])


def _spans(df: DataFrame, text: str, kind: Kind) -> DataFrame:
    """Add the kind's spans as column ``kind.name``: what lies between matches and the matches give the positions."""
    pattern = F.lit(kind.pattern)
    df = df.withColumn("__found", F.regexp_extract_all(text, pattern, F.lit(0)))
    # most texts have no match; they need neither the split nor the sums
    df = df.withColumn("__between", F.when(F.size("__found") > 0, F.split(F.col(text), kind.pattern, -1)))
    df = df.withColumn("__value", F.when(F.size("__found") > 0, F.regexp_extract_all(text, pattern, F.lit(kind.group))) if kind.group else F.col("__found"))
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__found") - 1) / RUN).cast("int")),
        lambda r: F.zip_with(
            F.slice("__between", r * RUN + 1, F.lit(RUN)),
            F.slice("__found", r * RUN + 1, F.lit(RUN)),
            lambda b, m: F.struct(F.length(b).alias("before"), F.length(m).alias("length")),
        ),
    )
    # the last run is padded by zip_with where the text goes on after the last match
    df = df.withColumn("__runs", F.when(F.size("__found") > 0, F.transform(runs, lambda run: _running(F.filter(run, lambda x: x["length"].isNotNull())))))
    sizes = F.transform("__runs", lambda run: F.struct(F.lit(0).alias("before"), F.element_at(run, -1)["end"].alias("length")))
    df = df.withColumn("__offset", F.when(F.size("__found") > 0, _running(sizes)))
    moved = F.flatten(F.zip_with("__runs", "__offset", lambda run, o: F.transform(run, lambda s: F.struct((s["start"] + o["start"]).alias("start"), (s["end"] + o["start"]).alias("end")))))
    long_enough = F.transform(F.filter(F.arrays_zip(moved.alias("s"), F.col("__value").alias("v")), lambda x: F.length(x["v"]) >= kind.least), lambda x: x["s"])
    df = df.withColumn(kind.name, F.when(F.size("__found") > 0, long_enough).otherwise(F.array().cast(SPAN)))
    return df.drop("__found", "__between", "__value", "__runs", "__offset")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked), one row per input row.

    Both are arrays of (start, rank, kind, end) in order; positions are code
    points, ends exclusive. ``base`` has the spans that need no partner,
    ``linked`` the weak ones that have theirs. A null text is an empty text,
    without spans. Ids may be null or repeat; other columns are not carried.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    for kind in KINDS:
        rows = _spans(rows, "__text", kind)
    rank = {k.name: i for i, k in enumerate(KINDS)}

    def tagged(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end")))

    def listed(weak: bool) -> Column:
        return F.array_sort(F.concat(*[tagged(k) for k in KINDS if k.weak == weak]))

    scanned = settle(rows.select("doc_id", F.sha2("__text", 256).alias("key"), listed(False).alias("base"), listed(True).alias("weak")))
    none = F.filter("weak", lambda s: F.lit(False)).alias("linked")
    # only texts with weak spans meet their links; copies of such a text are spread by Spark's split of skewed joins
    with_weak = scanned.where(F.size("weak") > 0).join(link(scanned, scope), "key", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))
    return scanned.where(F.size("weak") == 0).select("doc_id", "base", none).unionByName(with_weak)


def link(scanned: DataFrame, scope: int) -> DataFrame:
    """(key, linked): per text, its weak spans whose partners are in scope."""
    role = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, k.role)])
    # copies of one text are one text here
    some = scanned.where(F.size("weak") > 0).select("key", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    parts = some.select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"), role[F.col("s.kind")].alias("role"))
    bucket = lambda position: F.floor(position / scope).cast("int")
    near = parts.select("key", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("role").alias("p_role"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    weak = parts.where(F.col("kind").isin([k.name for k in KINDS if k.weak])).withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.col("start") - scope, F.lit(0))), bucket(F.col("end") + scope))))
    met = weak.join(near, ["key", "bucket"]).where("p_start - end <= {0} and start - p_end <= {0}".format(scope))
    has = {r: F.max(F.col("p_role") == r) for r in ("identifier", "secret")}
    needs = F.lit(False)
    for r, wanted in PARTNERS.items():
        ok = F.lit(True)
        for w in wanted:
            ok = ok & F.col(w)
        needs = needs | ((F.col("role") == r) & ok)
    kept = met.groupBy("key", "start", "end", "rank", "kind", "role").agg(*[c.alias(r) for r, c in has.items()]).where(needs)
    return kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("linked"))


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``."""
    found = scan(docs, **options)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
