"""Secret scans with multipart credential linking, all in DataFrame functions.

Strong findings stand alone. A credential also comes in parts: an access identifier, a secret and an endpoint, each of
which proves nothing by itself. Weak candidates for these parts are found by pattern and interval-joined, within scopes
of one document, with the parts of the other roles; a candidate is reported only where complementary parts co-occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import boxed, unboxed, written

#: Two parts are in one scope if at most so many code points lie between them.
SCOPE = 200
#: Longest span that a scope bin must meet with its neighbours; longer parts are entered in each bin they touch.
_BIN = 1024
_BLOCK = 4096
MASK = "[SECRET]"

# The base patterns, their kinds and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Weak candidates: a login or key identifier, an unnamed random string, an address of a service.
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?(?:id|name))?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}"""

# Of each kind: pattern, what a match must satisfy, its role, whether it is strong.
_HOW = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE, "secret", True),
    "access": (ACCESS, lambda m: F.length(m) >= LEAST_ACCESS, "identifier", True),
    "hex": (r"[0-9a-f]{16,}", lambda m: F.length(m) >= LEAST_HEX, "secret", True),
    "identifier": (IDENTIFIER, lambda m: F.lit(True), "identifier", False),
    "opaque": (OPAQUE, lambda m: F.lit(True), "secret", False),
    "endpoint": (ENDPOINT, lambda m: F.lit(True), "endpoint", False),
}
# A document without any of these has no span; each is necessary for its kind, so that this test loses nothing.
_ANY = {
    "assign": r"(?i)(?:passw|secret|token|api_?key)",
    "access": "AKIA",
    "hex": r"[0-9a-f]{16}",
}


def _found(text: Column, kind: str) -> Column:
    """An array of (kind, i, gap long, match long, ok): matches in order, each with the length of the text before it.

    Splitting at a pattern and extracting by it find the same matches, so that positions are sums of lengths.
    """
    pattern, test, _, _ = _HOW[kind]
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        matches,
        lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), test(m).alias("ok")),
    )


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, kind int, start long, end long) of every strong finding and weak candidate; ``key`` is (no, id, sha).

    Rows equal in id and text share a key and are searched once for each such row; positions are code points from 0,
    ends exclusive. Weak candidates are looked for only in texts with a strong finding or a candidate of two roles.
    """
    text = F.col("_t")
    strong = F.lit(False)
    for pattern in _ANY.values():
        strong = strong | F.rlike(text, F.lit(pattern))
    secret, name, place = F.rlike(text, F.lit(OPAQUE)), F.rlike(text, F.lit(IDENTIFIER)), F.contains(text, F.lit("://"))
    likely = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(strong | (place & name & secret))
    keyed = likely.select(_key("_id", "_t").alias("key"), "_t")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), _found(text, name).alias("found")) for k, name in enumerate(KINDS)))
    rows = keyed.select("key", F.explode(kinds).alias("x")).where(F.size("x.found") > 0)
    rows = rows.select("key", "x.kind", F.posexplode("x.found").alias("i", "m")).distinct()
    ends = rows.selectExpr(
        "key", "kind", "m.ok AS ok", "m.size AS size", "sum(m.gap + m.size) OVER (PARTITION BY key, kind ORDER BY i) AS `end`"
    )
    return ends.where("ok").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _key(id_col: str, text_col: str) -> Column:
    i, t = F.col(id_col), F.col(text_col)
    return F.struct(i.isNull().alias("no"), F.coalesce(i.cast("string"), F.lit("")).alias("id"), F.sha2(t, 256).alias("sha"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of ``found`` to report: every strong one, and weak ones that complementary parts support.

    Parts of one document are interval-joined by bins: each enters the bins that its span, widened by the scope, touches.
    A weak part is reported if parts of both other roles are in its scope, or one of another role that is strong.
    """
    role = F.element_at(F.array(*(F.lit(_HOW[k][2]) for k in KINDS)), F.col("kind") + 1)
    firm = F.element_at(F.array(*(F.lit(_HOW[k][3]) for k in KINDS)), F.col("kind") + 1)
    named = found.select("key", "kind", "start", "end", role.alias("role"), firm.alias("strong"))
    width = _BIN + scope
    lone = named.where("NOT strong").withColumn("bin", F.explode(F.sequence(F.floor((F.greatest(F.col("start") - scope, F.lit(0))) / width), F.floor((F.col("end") + scope) / width))))
    other = named.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    other = other.select("key", "bin", F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("strong").alias("strong2"))
    # What a bin has of a role is summed up to its extremes on either side of each candidate: no list of pairs is kept.
    near = lone.join(other, ["key", "bin"]).where(
        (F.col("role") != F.col("role2")) & (F.col("start2") <= F.col("end") + scope) & (F.col("end2") >= F.col("start") - scope)
        & ((F.col("start2") >= F.col("end")) | (F.col("end2") <= F.col("start")))
    )
    held = near.groupBy("key", "kind", "start", "end").agg(F.max("strong2").alias("firm"), F.countDistinct("role2").alias("roles"))
    weak = held.where("firm OR roles = 2").select("key", "kind", "start", "end")
    return named.where("strong").select("key", "kind", "start", "end").unionByName(weak)


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Each row's (id, spans array of (start, kind int, end) by start and kind): all that is reported of its text.

    Null and empty texts have no spans; very long ones are scanned whole; null ids and repeated rows are kept; other columns are
    not read; an empty table gives no rows. Spans of different kinds may overlap.
    """
    spans = linked(written(parts(docs, id_col, text_col), "secret-parts"), scope)
    each = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return _by_key(rows, each).select("id", F.coalesce("spans", none).alias("spans"))


def _by_key(rows: DataFrame, each: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``each`` (one row a key) by key.

    The key of ``each`` is an expression, so that both sides come straight from a shuffle and the planner can split rows that
    repeat a key over tasks (adaptive skew join).
    """
    again = F.struct(F.col("key.no").alias("no"), F.concat(F.col("key.id"), F.lit("")).alias("id"), F.col("key.sha").alias("sha"))
    return rows.join(each.select(again.alias("_key"), *(c for c in each.columns if c != "key")), F.col("key") == F.col("_key"), "left").drop("_key")


def digest(scanned: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) from :func:`scan`."""
    base = scanned.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return base.select(
        "id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask`` (overlapping or adjoining spans by one).

    All rows and columns stay, repeated ones and those of null ids or texts too; texts without a span are unchanged; an empty
    table gives no rows.
    """
    spans = linked(written(parts(docs, id_col, text_col), "secret-parts"), scope)
    far = spans.selectExpr("key", "start", "`end`", "max(`end`) OVER (PARTITION BY key ORDER BY start, `end` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    isles = far.selectExpr("key", "start", "`end`", "sum(IF(before >= start, 0, 1)) OVER (PARTITION BY key ORDER BY start, `end` ROWS UNBOUNDED PRECEDING) AS isle")
    merged = isles.groupBy("key", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    keyed = _by_key(docs.select(boxed(docs), F.col(text_col).alias("_text"), _key(id_col, text_col).alias("key")), cuts)
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)
    size = F.length("_text").cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(size))

    def kept(a: Column, b: Column) -> Column:
        def of_block(k: Column) -> Column:
            low = F.greatest(a - k * _BLOCK, F.lit(0))
            return F.substring(F.element_at(F.col("_blocks"), (k + 1).cast("int")), (low + 1).cast("int"), (F.least(b - k * _BLOCK, F.lit(_BLOCK)) - low).cast("int"))

        run = F.sequence(F.floor(a / _BLOCK), F.floor((b - 1) / _BLOCK))
        return F.when(b > a, F.array_join(F.transform(run, of_block), "")).otherwise("")

    clean = F.array_join(F.zip_with(starts, ends, kept), mask)
    blocked = keyed.withColumn("_blocks", F.when(F.col("_cuts").isNotNull(), blocks))
    new = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(clean)
    return unboxed(blocked.withColumn("_row", F.col("_row").withField(f"`{text_col}`", new)))


def recounted(text_col: str, count_col: str, mask: str = MASK) -> Column:
    """``count_col``, or the code points of a text that holds the mask."""
    return F.when(F.contains(F.col(text_col), F.lit(mask)), F.length(F.col(text_col)).cast("long")).otherwise(F.col(count_col))
