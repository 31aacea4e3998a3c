"""Column functions over single posts and analyses: media, links, counts, displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazalens.functions.text import any_of, strip
from plazalens.rules import phrases as P


def _marked(url: Column, marks: list[str], hint: str | None = None) -> Column:
    low = F.lower(url)
    found = any_of([low.contains(m) for m in marks] + [low.contains("format=" + m[1:]) for m in marks])
    return found | low.contains(hint) if hint else found


def media_type(urls: Column) -> Column:
    """video, image, mixed or '' of a list of links; video marks are tested first."""
    video = F.exists(urls, lambda u: _marked(u, P.VIDEO_MARKS, "video"))
    image = F.exists(urls, lambda u: ~_marked(u, P.VIDEO_MARKS, "video") & _marked(u, P.IMAGE_MARKS, "image"))
    return F.coalesce(
        F.when(video & image, "mixed").when(video, "video").when(image, "image").otherwise(""), F.lit("")
    )


def url_kind(url: Column) -> Column:
    """Kind of one captured link."""
    low = F.lower(url)
    return F.when(any_of(low.contains(m) for m in P.CAPTURED_VIDEO_MARKS), "video").otherwise("image")


def only_videos(urls: Column) -> Column:
    """Videos and no image; image marks are tested first."""
    image = F.exists(urls, lambda u: _marked(u, P.IMAGE_MARKS))
    video = F.exists(urls, lambda u: ~_marked(u, P.IMAGE_MARKS) & _marked(u, P.VIDEO_MARKS))
    return F.coalesce(video & ~image, F.lit(False))


def pick_media(urls: Column) -> Column:
    """Preferred link: mp4, then m3u8, then video-like, then the first; null when none."""

    def first(test) -> Column:
        return F.try_element_at(F.filter(urls, test), F.lit(1))

    return F.coalesce(
        first(lambda u: F.lower(u).contains(".mp4")),
        first(lambda u: F.lower(u).contains(".m3u8")),
        first(lambda u: any_of(F.lower(u).contains(h) for h in P.VIDEO_HINTS)),
        F.try_element_at(urls, F.lit(1)),
    )


def author_and_id(href: Column) -> Column:
    """Struct (author, post_id) of a status link; both null when it is none."""
    parts = F.split(F.regexp_replace(href, "^/+|/+$", ""), "/")
    ok = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(2)) == "status")
    author = F.when(ok, F.try_element_at(parts, F.lit(1)))
    post_id = F.when(ok, F.substring_index(F.try_element_at(parts, F.lit(3)), "?", 1))
    return F.struct(author.alias("author"), post_id.alias("post_id"))


def by_author(href: Column, username: Column) -> Column:
    """True for a status link of that very author."""
    link = author_and_id(href)
    return F.coalesce((link["author"] == username) & (link["post_id"] != ""), F.lit(False))


COUNT = r"([\d,.]+)\s*([KM])?"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"


def parse_count(text: Column) -> Column:
    """Abbreviated count (1,2K, 3M, plain digits) as a number; 0 when unreadable."""
    up = F.upper(strip(F.coalesce(text, F.lit(""))))
    body = strip(F.regexp_replace(F.substring(up, F.lit(1), F.length(up) - 1), ",", "."))
    scaled = F.when(body.rlike(NUMBER), body.try_cast("double"))
    digits = F.regexp_replace(up, "[^0-9]", "")
    return F.coalesce(
        F.when(up.endswith("K"), (scaled * 1000).cast("bigint"))
        .when(up.endswith("M"), (scaled * 1000000).cast("bigint"))
        .otherwise(digits.try_cast("bigint")),
        F.lit(0).cast("bigint"),
    )


def labelled_count(text: Column) -> Column:
    """The first number of a label such as '1,2K likes'; 0 when there is none."""
    up = F.upper(text)
    number = F.regexp_replace(F.regexp_extract(up, COUNT, 1), ",", ".")
    factor = F.create_map(F.lit("K"), F.lit(1e3), F.lit("M"), F.lit(1e6))[F.regexp_extract(up, COUNT, 2)]
    plain = F.regexp_replace(number, "[^0-9]", "").try_cast("bigint")
    return F.coalesce(F.when(factor.isNull(), plain).otherwise((number.try_cast("double") * factor).cast("bigint")), F.lit(0).cast("bigint"))


def stage_text(flags: dict[str, Column]) -> Column:
    """Comma list of the stages that ran, in pipeline order."""
    return F.array_join(F.array_compact(F.array(*[F.when(flags[s], F.lit(s)) for s in P.STAGES if s in flags])), ",")


def stage_flags(col: Column) -> Column:
    """Struct of booleans, one per stage of the comma list."""
    parts = F.split(F.coalesce(col, F.lit("")), ",")
    return F.struct(*[F.array_contains(parts, s).alias(s) for s in P.STAGES])


def best_explanation(external: Column, local: Column) -> Column:
    """External text unless blank, else the local one, else a default."""
    return (
        F.when(F.length(strip(F.coalesce(external, F.lit("")))) > 0, external)
        .when(F.coalesce(local, F.lit("")) != "", local)
        .otherwise(P.NO_ANALYSIS)
    )


def dual_explanations(external: Column, local: Column) -> Column:
    return (F.length(strip(F.coalesce(external, F.lit("")))) > 0) & (F.length(strip(F.coalesce(local, F.lit("")))) > 0)


def display_method(stages: Column, external_used: Column) -> Column:
    shown = F.when(F.coalesce(stages, F.lit("")) == "", "pattern").otherwise(stages)
    return F.when(F.coalesce(external_used, F.lit(False)), F.concat(shown, F.lit(" (external)"))).otherwise(shown)


def categories_list(encoded: Column, category: Column) -> Column:
    """JSON list of categories; unreadable or missing -> the single category."""
    fallback = F.when(F.coalesce(category, F.lit("")) != "", F.array(category)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.from_json(encoded, "array<string>"), fallback)


def relevance(query: Column, text: Column) -> Column:
    """Share of the distinct query words that the text has as words."""

    def words(col: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda w: w != ""))

    wanted = words(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, words(text))) / F.size(wanted)).otherwise(0.0)


def page_text(html: Column, limit: int | None = None) -> Column:
    """Paragraph text of a page, or its first ``limit`` characters: scripts and styles out, entities to blanks, whitespace squeezed."""
    body = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", "")
    body = F.regexp_replace(body, r"(?s)<style[^>]*>.*?</style>", "")
    text = F.array_join(F.regexp_extract_all(body, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), " ")
    text = F.regexp_replace(text, "&[^;]+;", " ")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return text if limit is None else F.substring(text, 1, limit)
