"""Chunkers: Column functions from a text to the array of its chunks.

A text is one file, whose size is limited before it is read, so each chunker
works inside its row: chunking needs no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions.tokens import TOKEN_ATOMIC, token_count
from repoquarry.params import STRUCTURED_LANGUAGES, IndexParams
from repoquarry.session import let


def windows(parts: Column, size: int, overlap: int, separator: str) -> Column:
    """Sliding windows of `size` parts, neighbours sharing `overlap`, each joined.

    The last window is the first one that reaches the end.
    """
    starts = F.sequence(
        F.lit(0), F.greatest(F.size(parts) - overlap, F.lit(1)) - 1, F.lit(size - overlap)
    )
    return F.transform(
        starts, lambda s: F.array_join(F.slice(parts, s + 1, F.lit(size)), separator)
    )


def split_by_chars(text: Column, limit: int | Column) -> Column:
    """Pieces of at most `limit` characters; a text within it stays whole."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    last = F.ceil(F.length(text) / limit).cast("int") - 1
    pieces = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * limit + 1, limit)
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces)


def line_windows(text: Column, lines: int, overlap: int, max_chars: int | None) -> Column:
    """Windows of lines; a window above `max_chars` is cut to that size."""
    cut = let(F.split(text, "\n", -1), lambda ls: windows(ls, lines, overlap, "\n"))
    if max_chars is None:
        return cut
    return F.flatten(F.transform(cut, lambda w: split_by_chars(w, max_chars)))


# --- token windows -----------------------------------------------------------

_PIECE = 64  # tokens; the regex engine nests once per token of a piece
_CHARS_PER_TOKEN = 16  # beyond this on average, a chunk is one unbroken run and is cut


def token_pieces(text: Column, limit: int) -> Column:
    """Text cut into pieces of at most `limit` tokens; joined, they are the text.

    A piece is the longest run of tokens that ends at a line break or at the end of
    the text, else the longest that ends at white space, else `limit` tokens. The
    pattern tries these in turn, so the regex engine does all the packing.
    """
    run = rf"(?:(?:{TOKEN_ATOMIC})\s*+){{1,{limit}}}"
    pattern = rf"\s*+(?:{run}(?:(?<=\n)|\z)|{run}(?<=\s)|{run})|\s++"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_windows(text: Column, max_tokens: int, overlap: int) -> Column:
    """Chunks of at most `max_tokens` tokens, neighbours sharing at most `overlap`.

    Pieces are added to a chunk as long as its tokens stay within the budget; the next
    chunk starts with the last pieces of this one that together stay within the overlap.
    A chunk that is very long for its tokens is cut by characters.
    """
    piece = min(_PIECE, overlap or _PIECE, max_tokens - overlap)
    limit = max_tokens * _CHARS_PER_TOKEN

    def from_pieces(pieces: Column) -> Column:
        return let(
            F.transform(pieces, token_count),
            lambda counts: F.transform(
                _fold_pieces(counts, max_tokens, overlap),
                lambda r: F.array_join(F.slice(pieces, r["s"] + 1, r["e"] - r["s"]), ""),
            ),
        )

    chunks = let(token_pieces(text, piece), from_pieces)
    return F.flatten(F.transform(chunks, lambda c: split_by_chars(c, limit)))


def _fold_pieces(counts: Column, budget: int, overlap: int) -> Column:
    """Ranges of neighbouring pieces, filled in order up to the budget of tokens."""
    state = "struct<s:int,n:int,done:array<struct<s:int,e:int>>>"

    def total(start: Column, end: Column) -> Column:
        return F.aggregate(F.slice(counts, start + 1, end - start), F.lit(0), lambda a, n: a + n)

    def step(acc: Column, i: Column) -> Column:
        n = F.get(counts, i)
        # Of the pieces before, those that the next chunk starts with: each has a token.
        first = F.greatest(acc["s"] + 1, i - overlap)
        start = F.get(F.filter(F.sequence(first, i), lambda j: total(j, i) <= overlap), F.lit(0))
        done = F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), i.alias("e"))))
        fresh = let(
            start, lambda j: F.struct(j.alias("s"), (total(j, i) + n).alias("n"), done.alias("done"))
        )
        grown = F.struct(acc["s"].alias("s"), (acc["n"] + n).alias("n"), acc["done"].alias("done"))
        return F.when((acc["n"] + n <= budget) | (acc["s"] == i), grown).otherwise(fresh)

    empty = F.from_json(F.lit('{"s":0,"n":0,"done":[]}'), state)
    last = F.size(counts)
    folded = F.aggregate(
        F.sequence(F.lit(0), last - 1),
        empty,
        step,
        lambda acc: F.concat(
            acc["done"], F.array(F.struct(acc["s"].alias("s"), last.alias("e")))
        ),
    )
    return F.when(last > 0, folded).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


# --- declaration chunks ------------------------------------------------------

# A line that opens a declaration, and a line that belongs to the one below it.
_TYPE_WORDS = "class|interface|enum|record|struct|namespace"
_C_MODIFIERS = (
    "public|private|protected|internal|static|final|abstract|sealed|virtual|override"
    "|async|partial|readonly|synchronized|native|default|unsafe|extern|new"
)
_C_OPENERS = (
    rf"^\s*(?:(?:{_C_MODIFIERS})\s+)*(?:{_TYPE_WORDS})\s+\w"
    rf"|^\s*(?:(?:{_C_MODIFIERS})\s+)+[\w<>\[\],.? ]+\("
)
OPENERS = {
    "python": r"^\s*(?:async\s+def|def|class)\s",
    "typescript": (
        r"^\s*(?:(?:export|default|declare|abstract|async)\s+)*"
        r"(?:function|class|interface|enum|type|namespace|module)\b"
        r"|^\s*(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|function\b)"
        r"|^\s+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)+[\w$]+\s*\("
        r"|^\s+constructor\s*\("
    ),
    "java": _C_OPENERS,
    "csharp": _C_OPENERS,
}
LEADERS = {
    "python": r"^\s*[@#]",
    "typescript": r"^\s*(?:@|//|/\*|\*)",
    "java": r"^\s*(?:@|//|/\*|\*)",
    "csharp": r"^\s*(?:\[|//|/\*|\*)",
}


def _starts_block(line: Column, before: Column, opener: str, leader: str) -> Column:
    """A declaration starts at its first leading line, or at its opening line when
    no leading line stands above."""
    led = F.coalesce(before.rlike(leader), F.lit(False))
    return (line.rlike(opener) | line.rlike(leader)) & ~led


def _ranges(lines: Column, sizes: Column, start: Column, end: Column, begins) -> Column:
    """Cut lines [start, end) where `begins` holds; each range with its size."""
    inner = F.filter(F.sequence(start, end - 1), lambda i: (i > start) & begins(i))
    bounds = F.concat(F.array(start), inner, F.array(end))
    return let(
        bounds,
        lambda b: F.transform(
            F.sequence(F.lit(0), F.size(b) - 2),
            lambda j: F.struct(
                F.get(b, j).alias("s"),
                F.get(b, j + 1).alias("e"),
                F.aggregate(
                    F.slice(sizes, F.get(b, j) + 1, F.get(b, j + 1) - F.get(b, j)),
                    F.lit(0),
                    lambda acc, n: acc + n,
                ).alias("n"),
            ),
        ),
    )


def _pack_ranges(ranges: Column, budget: int) -> Column:
    """Merge neighbouring ranges greedily while the sum stays within the budget."""
    kind = "struct<s:int,e:int,n:int>"
    first = F.struct(
        F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done")
    )

    def step(acc: Column, r: Column) -> Column:
        cur = acc["cur"]
        merged = F.struct(cur["s"].alias("s"), r["e"].alias("e"), (cur["n"] + r["n"]).alias("n"))
        return (
            F.when(cur.isNull(), F.struct(r.alias("cur"), acc["done"].alias("done")))
            .when(
                cur["n"] + r["n"] <= budget,
                F.struct(merged.alias("cur"), acc["done"].alias("done")),
            )
            .otherwise(
                F.struct(
                    r.alias("cur"), F.concat(acc["done"], F.array(cur)).alias("done")
                )
            )
        )

    return F.aggregate(
        ranges, first, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"]))
    )


def _declaration_ranges(lines: Column, sizes: Column, language: str, budget: int) -> Column:
    opener, leader = OPENERS[language], LEADERS[language]

    def begins(i: Column) -> Column:
        return _starts_block(F.get(lines, i), F.get(lines, i - 1), opener, leader)

    def begins_outer(i: Column) -> Column:
        return F.get(lines, i).rlike(r"^\S") & begins(i)

    def single_lines(r: Column) -> Column:
        return F.transform(
            F.sequence(r["s"], r["e"] - 1),
            lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.get(sizes, i).alias("n")),
        )

    def by_lines(r: Column) -> Column:
        return F.when(r["n"] <= budget, F.array(r)).otherwise(single_lines(r))

    def by_inner(r: Column) -> Column:
        inner = _ranges(lines, sizes, r["s"], r["e"], begins)
        return F.when(r["n"] <= budget, F.array(r)).otherwise(
            F.flatten(F.transform(inner, by_lines))
        )

    outer = _ranges(lines, sizes, F.lit(0), F.size(lines), begins_outer)
    return _pack_ranges(F.flatten(F.transform(outer, by_inner)), budget)


def _enclosing_line(lines: Column, start: Column, opener: str) -> Column:
    """Opening line of the outermost declaration that line `start` is inside of,
    with a newline; '' when it is inside of none."""
    above = F.filter(F.slice(lines, F.lit(1), start), lambda x: x.rlike(r"^\S") & x.rlike(opener))
    inside = F.get(lines, start).rlike(r"^\s") & (F.size(above) > 0)
    return F.when(inside, F.concat(F.element_at(above, -1), F.lit("\n"))).otherwise("")


def declaration_chunks(
    text: Column, language: str, budget: int, overlap: int, expand: bool = False
) -> Column:
    """Chunks of whole declarations.

    Sizes count characters other than white space. Outermost declarations stay
    whole within the budget; a larger one is cut at the declarations inside it, and
    those at lines. Small neighbours are then merged up to the budget. A chunk
    starts with the last `overlap` lines of the one before; a single line above
    the budget is cut by characters. With `expand`, a chunk that starts inside an
    outermost declaration is preceded by that declaration's opening line.
    """

    def texts(lines: Column, r: Column, before: Column) -> Column:
        start = F.greatest(r["s"] - overlap, F.coalesce(before["s"], r["s"]))
        whole = F.array_join(F.slice(lines, start + 1, r["e"] - start), "\n")
        if expand:
            whole = F.concat(_enclosing_line(lines, start, OPENERS[language]), whole)
        return F.when(r["n"] <= budget, F.array(whole)).otherwise(
            split_by_chars(F.get(lines, r["s"]), budget)
        )

    def from_ranges(lines: Column, ranges: Column) -> Column:
        return F.flatten(
            F.transform(ranges, lambda r, k: texts(lines, r, F.get(ranges, k - 1)))
        )

    def from_lines(lines: Column) -> Column:
        sizes = F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"\s", "")))
        ranges = let(sizes, lambda ns: _declaration_ranges(lines, ns, language, budget))
        return let(ranges, lambda rs: from_ranges(lines, rs))

    return let(F.split(text, "\n", -1), from_lines)


# --- notebooks ---------------------------------------------------------------


def cell_chunks(text: Column, budget: int) -> Column:
    """Chunks of whole cells of a notebook's text: neighbours together up to `budget`
    characters, a larger cell cut to that size."""

    def from_cells(cells: Column) -> Column:
        one = F.transform(
            F.sequence(F.lit(0), F.size(cells) - 1),
            lambda i: F.struct(
                i.alias("s"), (i + 1).alias("e"), F.length(F.get(cells, i)).alias("n")
            ),
        )
        return F.flatten(
            F.transform(
                _pack_ranges(one, budget),
                lambda r: split_by_chars(
                    F.array_join(F.slice(cells, r["s"] + 1, r["e"] - r["s"]), "\n"),
                    # Line breaks between cells are not counted as their size.
                    F.when(r["n"] <= budget, budget + r["e"] - r["s"]).otherwise(budget),
                ),
            )
        )

    return let(F.split(text, r"\n(?=\n## \w+ Cell \d+\n)", -1), from_cells)


# --- routing -----------------------------------------------------------------


def route(
    text: Column, language: Column, params: IndexParams, notebook: Column | None = None
) -> Column:
    """Chunks of a text: a notebook's by cells, others by their language: declarations,
    lines, or tokens when it is unknown. One expression, so every file is read once."""
    by_cell = F.lit(False) if notebook is None else notebook
    chunks = F.when(by_cell, cell_chunks(text, params.max_chars)).when(
        language.isNull(), token_windows(text, params.max_tokens, params.token_overlap)
    )
    for name in STRUCTURED_LANGUAGES:
        chunks = chunks.when(
            language == name,
            declaration_chunks(
                text, name, params.max_chars, params.declaration_overlap, params.expand_chunks
            ),
        )
    return chunks.otherwise(
        line_windows(text, params.chunk_lines, params.chunk_lines_overlap, params.max_chars)
    )


def with_path_header(path: Column, chunk: Column) -> Column:
    """A chunk preceded by the path it comes from."""
    return F.concat(path, F.lit("\n"), chunk)
