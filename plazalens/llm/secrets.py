"""Secret scans with corpus-wide ownership frequency (native: DataFrame functions only).

Three base patterns give candidate spans. The method adds *owned* spans: long tokens that mix
letters and digits, outside every base span, when one owner alone has the value.

Every candidate value is hashed and counted over the whole corpus by distinct owners (``source``)
and repositories (documents, unless a column is named). A value that at least EXAMPLE_OWNERS
owners have is a widely copied example; the others look live.

Positions come from the pieces between matches: the pattern that splits a text into pieces also
lists its matches, so summed lengths give begin and end in code points.

Defined results: a null or empty text has no span; repeated rows count as one repository; a null
source is an owner of its own; an empty table gives no rows; other columns are left aside, or pass
whatever their names. Texts are read whole; the time of a text grows with its length and spans, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import fresh, written

#: The contract's patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Tokens that the method adds when one owner alone has them.
OWNED = r"[A-Za-z0-9+/_-]{20,}"
#: Three digits and three letters or more.
MIXED = "^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z])"
EXAMPLE_OWNERS = 3

KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,kind:int,stop:int,value:bigint>>"


#: Elements that an array grows by at a time. Growing by one copies what is there, so a long text's spans
#: are gathered in blocks, and the blocks in one array.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def walked(items: Column, start: Column, step, kind: str) -> Column:
    """What ``step`` gives along an array, in order: it takes (state, item) and returns (state, array of ``kind``)."""
    none = F.array().cast(f"array<{kind}>")

    def one(state, item):
        after, given = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], given).alias("out"))

    def blocks(whole):
        def block(state, k):
            part = F.slice(whole, k * BLOCK + 1, BLOCK)
            inner = F.aggregate(part, F.struct(state["carry"].alias("carry"), none.alias("out")), one)
            return bound(inner, lambda x: F.struct(x["carry"].alias("carry"), F.concat(state["out"], F.array(x["out"])).alias("out")))

        zero = F.struct(start.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))
        return F.when(F.size(whole) == 0, none).otherwise(F.flatten(F.aggregate(numbers, zero, block, lambda x: x["out"])))

    return bound(items, blocks)


def _spans(kind: int, pattern: str, least: int, value_group: int = 0, test: str | None = None) -> Column:
    """Spans of all matches whose value has ``least`` characters or more and passes ``test``."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found

    def row(m, p):
        return F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size"))

    def valued(a, v):
        keep = (F.char_length(v) >= least) & (v.rlike(test) if test else F.lit(True))
        return F.struct(a["gap"].alias("gap"), a["size"].alias("size"), keep.alias("keep"), F.xxhash64(v).alias("value"))

    # The last piece follows the last match: it has no match beside it and goes.
    rows = F.filter(F.zip_with(F.zip_with(found, F.split(text, pattern, -1), row), values, valued), lambda r: r["size"].isNotNull())

    def step(at, r):
        begin = at + r["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + r["size"]).alias("stop"), r["value"].alias("value"))
        return begin + r["size"], F.when(r["keep"], F.array(span)).otherwise(F.array().cast(SPAN))

    return walked(rows, F.lit(0), step, SPAN[6:-1])


def _only_if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def outside(extra: Column, base: Column) -> Column:
    """Spans of ``extra``, which follow one another, that overlap none of ``base``; one merge of both by their begin."""
    end = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(-1).alias("kind"), F.lit((1 << 31) - 1).alias("stop"), F.lit(0).cast("long").alias("value"))
    both = F.sort_array(F.concat(base, extra, F.array(end)))
    kind = f"struct<reach:int,open:array<{SPAN[6:-1]}>>"
    none = F.array().cast(SPAN)

    def step(state, s):
        # ``open`` holds the last extra span, which a base span that begins inside it still takes away.
        own = s["kind"] == KINDS.index("owned")
        given = F.filter(state["open"], lambda o: own | (o["stop"] <= s["start"]))
        held = F.when(own & (state["reach"] <= s["start"]), F.array(s)).otherwise(none)
        reach = F.when(own, state["reach"]).otherwise(F.greatest(state["reach"], s["stop"]))
        return F.struct(reach.alias("reach"), held.alias("open")).cast(kind), given

    start = F.struct(F.lit(0).alias("reach"), none.alias("open")).cast(kind)
    return F.when(F.size(extra) == 0, none).otherwise(walked(both, start, step, SPAN[6:-1]))


def candidates(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """Per row: doc_id, text_key, owner, repository and the arrays ``base`` and ``extra``."""
    text = F.col("text")
    repo = F.col(repository).cast("string") if repository else F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repository"))
    # Short runs of hex digits fill prose; a run of HEX_LEAST or more is found at the same place
    # by the bounded pattern, as a greedy match takes whole runs either way. The same holds for
    # access keys.
    base = F.concat(
        _only_if(text.rlike(ASSIGN), _spans(0, ASSIGN, ASSIGN_LEAST, 2)),
        _only_if(text.contains("AKIA"), _spans(1, ACCESS, ACCESS_LEAST)),
        _only_if(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), _spans(2, HEX.replace("+", f"{{{HEX_LEAST},}}"), HEX_LEAST)),
    )
    extra = _only_if(text.rlike("[0-9]") & text.rlike(OWNED.replace(",", "")), _spans(3, OWNED, 20, test=MIXED))
    both = F.struct(F.sort_array(base).alias("base"), extra.alias("extra"))
    both = bound(both, lambda x: F.struct(x["base"].alias("base"), outside(x["extra"], x["base"]).alias("extra")))
    return rows.withColumn("both", both).select("doc_id", "text_key", "owner", "repository", "both.base", "both.extra")


def ownership(rows: DataFrame) -> DataFrame:
    """Per candidate value: number of distinct owners and repositories.

    Distinct triples are gathered first, so a value that a third of all rows hold is summed map
    side before any of it is shuffled by value alone.
    """
    spans = rows.select("owner", "repository", F.explode(F.concat("base", "extra")).alias("span")).select("owner", "repository", "span.value")
    by_owner = spans.distinct().groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key and ``found``, its spans in order, each with kind
    number, begin, end, owners, repositories and ``live``.

    Texts are read once; only the small table of candidates is shuffled.
    """
    rows = written(candidates(docs, owner, repository), "candidates")
    without = (F.size("base") == 0) & (F.size("extra") == 0)
    kind = "array<struct<start:int,kind:int,stop:int,owners:bigint,repositories:bigint,live:boolean>>"
    clean = rows.where(without).select("doc_id", "text_key", F.array().cast(kind).alias("found"))
    hits = rows.where(~without)
    # ``row`` tells repeated rows apart; it is read from the written table.
    hits = hits.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_key", F.explode(F.concat("base", "extra")).alias("span"))
    judged = hits.select("row", "doc_id", "text_key", "span.*").join(written(ownership(rows), "owners"), "value")
    span = F.struct("start", "kind", "stop", "owners", "repositories", (F.col("owners") < example_owners).alias("live"))
    kept = F.when((F.col("kind") < 3) | (F.col("owners") == 1), span)
    found = judged.groupBy("row", "doc_id", "text_key").agg(F.sort_array(F.collect_list(kept)).cast(kind).alias("found"))
    return clean.unionByName(found.drop("row"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``scan`` over ``docs``."""
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every live span replaced; overlapping spans give one mark.

    A block of spans is cut from the stretch of text that it covers, so no span counts from the text's begin.
    """

    def cut(whole, live):
        def block(state, k):
            part = F.slice(live, k * BLOCK + 1, BLOCK)
            reach = F.greatest(state["at"], F.array_max(F.transform(part, lambda s: s["stop"])))

            def pieces(stretch, base):
                def step(inner, s):
                    fresh = s["start"] >= inner["at"]
                    gap = F.substring(stretch, inner["at"] - base + 1, s["start"] - inner["at"])
                    more = F.when(fresh, F.concat(inner["out"], F.array(gap, F.lit(mark)))).otherwise(inner["out"])
                    return F.struct(F.greatest(inner["at"], s["stop"]).alias("at"), more.alias("out"))

                zero = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
                return F.aggregate(part, zero, step, lambda x: F.array_join(x["out"], ""))

            done = bound(F.substring(whole, state["at"] + 1, reach - state["at"]), lambda stretch: pieces(stretch, state["at"]))
            return F.struct(reach.alias("at"), F.concat(state["out"], F.array(done)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(live) - 1) / BLOCK).cast("int"))
        return F.aggregate(numbers, zero, block, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(whole, x["at"] + 1, F.char_length(whole))))

    found = F.filter(spans, lambda s: s["live"])
    return F.when(~F.exists(spans, lambda s: s["live"]), text).otherwise(bound(found, lambda live: cut(text, live)))


def suspect(text: Column) -> Column:
    """True for every text that can hold a span; a cheap test that needs no other row."""
    test = text.rlike(ASSIGN) | text.contains("AKIA") | text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}") | (text.rlike("[0-9]") & text.rlike(OWNED.replace(",", "")))
    return F.coalesce(test, F.lit(False))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with live secrets replaced in ``text`` and ``n_chars`` set anew. Rows and columns
    stay. Texts without any candidate are neither shuffled nor joined."""
    id_, key, found_, row_key = fresh(docs, "id", "key", "found", "row_key")
    found = scan(docs).where(F.exists("found", lambda s: s["live"])).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("found").alias(found_))
    some = docs.where(suspect(F.col("text"))).withColumn(row_key, F.xxhash64("text"))
    both = some.join(found, some["doc_id"].eqNullSafe(F.col(id_)) & (F.col(row_key) == F.col(key)), "left")
    text = F.when(F.col(found_).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(found_)))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(found_).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return docs.where(~suspect(F.col("text"))).unionByName(both.withColumns(out).select(*docs.columns))
