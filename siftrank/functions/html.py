"""Text, title and meta tags of an HTML page, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# The tags that stand for white space.
SPACING_PAIRED = "p|div|td|li|q|blockquote|dt|h1|h2|h3|h4|h5|h6"  # opening and closing
SPACING_SINGLE = "hr|br"
# Length of a page summary.
SUMMARY_LENGTH = 200

# Attributes up to the end of a tag; a ">" inside quotes does not end it.
REST_OF_TAG = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*|/)?>"""

SCRIPT = r"(?is)<script\b.*?</script\s*>"
COMMENT = r"(?s)<!--.*?-->"
DECLARATION = r"(?s)<![^>]*>"
TITLE = rf"(?is)<title{REST_OF_TAG}([^<]*)"
STYLE = rf"(?is)<style{REST_OF_TAG}[^<]*"
IMAGE_ALT = r"""(?is)<img\s(?:[^>"']|"[^"]*"|'[^']*')*?\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))(?:[^>"']|"[^"]*"|'[^']*')*>"""
SPACING = rf"(?is)<(?:/?(?:{SPACING_PAIRED})|(?:{SPACING_SINGLE})){REST_OF_TAG}"
TAG = r"""(?is)</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-z][^>]*>"""
META = r"""(?is)(<meta\s(?:[^>"']|"[^"]*"|'[^']*')*>)"""
META_NAME = r"""(?is)\s(?:name|http-equiv)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
META_CONTENT = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
# An entity, a run of other text, or a lone ampersand.
ENTITY_OR_TEXT = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z]+[0-9]*;?|[^&]+|&)"


def _java(pattern: str) -> str:
    """The loops over attributes made possessive: Java's matcher would otherwise
    keep a stack frame per character of a long tag."""
    loop = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
    eager = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
    return pattern.replace(loop + "?", "\0").replace(loop, eager).replace("\0", loop + "?")


def without_scripts(html: Column) -> Column:
    for pattern in (SCRIPT, COMMENT, DECLARATION):
        html = F.regexp_replace(html, pattern, "")
    return html


def title(html: Column) -> Column:
    """Text from the title tag to the next tag, spaces run together."""
    return _tidy(decode_entities(F.regexp_extract(without_scripts(html), _java(TITLE), 1)))


def body_text(html: Column, with_title: bool = True) -> Column:
    """All text but scripts, styles and comments. Alternative texts of images stay
    as ``[alt]``, block tags become spaces, other tags vanish."""
    text = F.regexp_replace(without_scripts(html), _java(STYLE), "")
    if not with_title:
        text = F.regexp_replace(text, _java(TITLE), "")
    text = F.regexp_replace(text, _java(IMAGE_ALT), r"[$1$2$3]")
    text = F.regexp_replace(text, _java(SPACING), " ")
    text = F.regexp_replace(text, _java(TAG), "")
    return _tidy(decode_entities(text))


def meta_tags(html: Column) -> Column:
    """Map from lower-cased name (or http-equiv) to lower-cased content; the last
    tag of a name wins."""

    def attribute(tag: Column, pattern: str) -> Column:
        return F.lower(F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]))

    tags = F.regexp_extract_all(without_scripts(html), F.lit(_java(META)), F.lit(1))
    pairs = F.transform(
        F.filter(tags, lambda t: t.rlike(META_NAME) & t.rlike(META_CONTENT)),
        lambda t: F.struct(
            attribute(t, META_NAME).alias("name"), attribute(t, META_CONTENT).alias("content")
        ),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["name"] == p["name"]
        ),
    )
    return F.map_from_entries(last)


def decode_entities(text: Column) -> Column:
    """Named entities of HTML 4 and numeric ones; an unknown name becomes empty.
    Text without an ampersand is passed through."""
    pieces = F.regexp_extract_all(text, F.lit(ENTITY_OR_TEXT), F.lit(1))
    return F.when(
        F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, _decode_piece), "")
    ).otherwise(text)


def _named() -> Column:
    entries = []
    for name, code in name2codepoint.items():
        entries += [F.lit(name), F.lit(chr(code))]
    return F.create_map(*entries)


def _decode_piece(piece: Column) -> Column:
    core = F.regexp_replace(piece, "^&#?[xX]?|;$", "")
    core = F.when(piece.startswith("&#"), F.regexp_replace(core, "^0+(?=.)", "")).otherwise(core)
    hexadecimal = piece.rlike("^&#[xX]")
    numeric = piece.startswith("&#") & (F.length(piece) > 2)
    code = F.when(hexadecimal, F.lpad(core, 8, "0")).otherwise(
        F.lpad(F.hex(core.cast("long")), 8, "0")
    )
    return (
        F.when(~piece.startswith("&") | (F.length(piece) == 1), piece)
        .when(numeric & (F.length(core) > 8), F.lit(""))
        .when(numeric, _character(code))
        .otherwise(F.coalesce(F.try_element_at(_named(), F.regexp_replace(piece, "^&|;$", "")), F.lit("")))
    )


def _character(code: Column) -> Column:
    """The character of a code point given as eight hexadecimal digits."""
    known = (F.upper(code) <= "0010FFFF") & ~F.upper(code).between("0000D800", "0000DFFF")
    return F.when(known, F.decode(F.unhex(code), "UTF-32")).otherwise(F.lit(""))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summary(text: Column, title: Column, length: int = SUMMARY_LENGTH) -> Column:
    """The first characters of the text, or the title when those begin with it or
    are empty. An empty title does not empty the summary."""
    start = F.trim(F.substring(text, 1, length))
    return F.when(
        (start == "") | ((title != "") & start.startswith(title)), title
    ).otherwise(start)
