"""Column functions over text: decoding, trimming, notebooks, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.params import LOCAL_ZONE
from repoquarry.session import let

# All characters that Python's str.isspace accepts.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SPACE = r"\s\x1c-\x1f"


def remove_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def strip(text: Column) -> Column:
    """Python's str.strip; looks at the ends of the text only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, '' and text of white space only; stops at the first other
    character, so it does not copy the text."""
    return ~F.coalesce(text.rlike(rf"(?U)[^{_SPACE}]"), F.lit(False))


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8, malformed sequences become U+FFFD, any line ending
    becomes a newline, a byte order mark stays."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


def notebook_text(content: Column) -> Column:
    """Text of a notebook, NULL when it cannot be parsed.

    Cells are numbered by their position in the file, blank ones are left out.
    The whole notebook is one row, so this needs no shuffle.
    """
    raw = content.cast("string")
    # The parser stops after the first value. Anything behind it breaks at least
    # one of these two frames, or makes the array longer than one.
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(raw), F.concat(F.lit("["), raw, F.lit("]"))))
    framed = F.try_parse_json(F.concat(F.lit('{"nb":'), raw, F.lit("}")))

    def body(array: Column) -> Column:
        one = F.try_variant_get(array, "$", "array<variant>")
        alone = (F.size(one) == 1) & framed.isNotNull()
        return let(F.when(alone, F.get(one, F.lit(0))), notebook)

    def notebook(nb: Column) -> Column:
        cells = F.try_variant_get(nb, "$.cells", "array<variant>")
        read = F.transform(
            cells,
            lambda c, i: F.struct(
                (i + 1).alias("n"),
                F.try_variant_get(c, "$.cell_type", "string").alias("kind"),
                F.coalesce(
                    F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""),
                    F.try_variant_get(c, "$.source", "string"),
                    F.lit(""),
                ).alias("source"),
            ),
        )
        supported = F.try_variant_get(nb, "$.nbformat", "int") == 4
        return F.when(
            supported & cells.isNotNull(),
            let(read, lambda r: F.when(~F.exists(r, lambda c: c["kind"].isNull()), _cells(r))),
        )

    return let(parsed, body)


def _cells(read: Column) -> Column:
    """Fixed formats of the three kinds of cell, joined by newlines."""
    kept = F.filter(read, lambda c: ~is_blank(c["source"]))
    return F.array_join(
        F.transform(
            kept,
            lambda c: F.when(
                c["kind"] == "code",
                F.format_string("\n## Code Cell %d\n```python\n%s\n```", c["n"], c["source"]),
            ).otherwise(
                F.format_string(
                    "\n## %s Cell %d\n%s", F.initcap(c["kind"]), c["n"], c["source"]
                )
            ),
        ),
        "\n",
    )


def human_bytes(size: Column) -> Column:
    """Size with one decimal in B, KB, MB, GB or TB; ties round to even."""
    value = size.cast("double")

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(value / float(1024**power), 1))

    return (
        F.when(value < 1024.0, shown(0, "B"))
        .when(value < 1024.0**2, shown(1, "KB"))
        .when(value < 1024.0**3, shown(2, "MB"))
        .when(value < 1024.0**4, shown(3, "GB"))
        .when(value.isNotNull(), shown(4, "TB"))
    )


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 8)


def or_default(text: Column, default: str) -> Column:
    """`default` in place of NULL and of the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def local_time(utc: Column) -> Column:
    """Wall-clock time in the zone of the audit stamps, from a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc.cast("timestamp_ntz"))
