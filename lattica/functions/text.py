"""Chunking, detection and extraction on text columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs by which kinds of content are known.
MATH_SIGNS = [
    "\\begin{equation}", "\\end{equation}",
    "\\begin{align}", "\\end{align}",
    "\\begin{gather}", "\\end{gather}",
    "\\[", "\\]",
    "\\(", "\\)",
    "$$", "$",
]
CODE_SIGNS = [
    "```",
    "def ", "class ", "lambda ",
    "function ", "const ", "var ", "let ", "=>",
    "public ", "private ", "void ", "static ",
    "import ", "from ", "require(",
    "#include", "using namespace",
    "package ", "module ",
    "struct ", "impl ", "fn ",
    "func ", "type ", "interface ",
]
FIGURE_SIGNS = ["Figure", "figure", "Fig.", "fig.", "\\begin{figure}", "\\includegraphics", "plot", "graph", "diagram", "illustration"]
TABLE_SIGNS = ["Table", "table", "Tab.", "\\begin{table}", "\\begin{tabular}", "|---|", "┌", "├", "└"]
LATEX_HEADERS = ["\\section{", "\\subsection{", "\\subsubsection{", "\\chapter{", "\\paragraph{"]

# Primitives and their patterns on lower-case text. Stems such as 'optimiz' match whole words only.
PRIMITIVES = {
    "attention": r"\b(attention|self-attention|multi-head|attention mechanism)\b",
    "transformer": r"\b(transformer|bert|gpt|encoder|decoder)\b",
    "embedding": r"\b(embedding|embed|representation|vector space)\b",
    "neural": r"\b(neural|neuron|layer|deep learning)\b",
    "optimization": r"\b(optimiz|gradient|sgd|adam|loss function)\b",
    "matrix": r"\b(matrix|matrices|tensor|multiplication)\b",
    "probability": r"\b(probability|distribution|likelihood|bayesian)\b",
    "dimension": r"\b(dimension|dimensional|space|projection)\b",
    "algorithm": r"\b(algorithm|procedure|method|approach)\b",
    "training": r"\b(train|training|learning|convergence)\b",
    "theorem": r"\b(theorem|proof|lemma|proposition)\b",
    "complexity": r"\b(complexity|computational|efficiency|runtime)\b",
    "classification": r"\b(classification|classify|categorize)\b",
    "generation": r"\b(generat|synthesis|create|produce)\b",
    "prediction": r"\b(predict|forecast|estimate)\b",
}
#: The same with stems that match all their words.
STEM_PRIMITIVES = PRIMITIVES | {"optimization": r"\b(optimiz\w*|gradient|sgd|adam|loss function)\b", "generation": r"\b(generat\w*|synthesis|create|produce)\b"}

# Stop words of the token overlap.
STOP_WORDS = """the a an and or but in on at to for
of with by from as is was are were be
been being have has had do does did will
would could should may might must can this
that these those i you he she it we they""".split()

# Words of titles of theory and of practice.
THEORY_WORDS = ["theory", "framework", "model", "analysis"]
PRACTICE_WORDS = ["implementation", "application", "case", "study"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once; within a lambda, an expression of the row would be worked out for every element."""
    return F.transform(F.array(value), use)[0]


def any_of(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])


def count_of(text: Column, sign: str) -> Column:
    """Occurrences that do not overlap."""
    return F.regexp_count(text, F.lit(_quoted(sign)))


def _quoted(sign: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", sign)


def total_of(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_of(text, s) for s in signs])


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Split at white space after . ! ? and before a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def sections(text: Column) -> Column:
    return F.split(text, r"(?m)^## |\n## ")


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` words, each ``size - overlap`` words after the one before; the last may be short or lie within the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return let(words(text), windows)


def has_math(text: Column) -> Column:
    return any_of(text, MATH_SIGNS)


def has_code(text: Column) -> Column:
    return any_of(text, CODE_SIGNS)


def has_figures(text: Column) -> Column:
    return any_of(text, FIGURE_SIGNS)


def has_tables(text: Column) -> Column:
    return any_of(text, TABLE_SIGNS)


def chunk_type(text: Column, flags: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """equation, code, figure_caption, table, mixed or text; earlier kinds win. Overlapping math signs count each.

    ``flags`` are those of math, code, figures and tables, where a frame has them as columns already.
    """
    math, code, figure, tab = flags or (has_math(text), has_code(text), has_figures(text), has_tables(text))
    kinds = math.cast("int") + code.cast("int") + figure.cast("int") + tab.cast("int")
    return (
        F.when(math & (total_of(text, MATH_SIGNS) / F.length(text) > 0.1), "equation")
        .when(code & (F.contains(text, F.lit("```")) | (total_of(text, CODE_SIGNS) > 5)), "code")
        .when(code, "mixed")
        .when(figure & (F.contains(text, F.lit("\\begin{figure}")) | (count_of(text, "Fig") > 2)), "figure_caption")
        .when(tab & any_of(text, ["\\begin{table}", "\\begin{tabular}"]), "table")
        .when(kinds > 1, "mixed")
        .otherwise("text")
    )


def section_header(text: Column, in_capitals: bool = True) -> Column:
    """The first of the first ten lines, at most 100 characters long, that is a header; null if none is.

    Headers are marked with #, LaTeX commands, a leading number, or are several words in capitals (given in title case; not with ``in_capitals`` off).
    """

    def header(line: Column) -> Column:
        latex = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(c)) for c in LATEX_HEADERS])
        inside = F.regexp_extract(line, r"\{(.+)\}", 1)
        capitals = (F.upper(line) == line) & (F.lower(line) != line) & line.rlike(r"\S\s+\S") & ~line.rlike(r"\d")
        marked = (
            F.when((line == "") | (F.length(line) > 100), F.lit(None).cast("string"))
            .when(F.startswith(line, F.lit("#")), F.trim(F.regexp_replace(line, "^#+|#+$", "")))
            .when(latex & (inside != ""), inside)
            .when(line.rlike(r"^\d+\.?\d*\s+[A-Z][a-zA-Z\s]+$"), line)
        )
        return marked.when(capitals, F.initcap(F.lower(line))) if in_capitals else marked

    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda s: header(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.try_element_at(F.array_compact(lines), F.lit(1))


def code_blocks(text: Column) -> Column:
    """Fenced blocks as (language, content)."""
    fence = r"(?s)```(\w*)\n(.*?)```"
    langs, bodies = F.regexp_extract_all(text, F.lit(fence), F.lit(1)), F.regexp_extract_all(text, F.lit(fence), F.lit(2))
    return F.zip_with(langs, bodies, lambda a, b: F.struct(F.when(a == "", "unknown").otherwise(a).alias("language"), b.alias("content")))


def figures(text: Column) -> Column:
    """Markdown images as (figure_id, caption, path), numbered from 1."""
    image = r"!\[([^\]]*)\]\(([^\)]+)\)"
    captions, paths = F.regexp_extract_all(text, F.lit(image), F.lit(1)), F.regexp_extract_all(text, F.lit(image), F.lit(2))
    pairs = F.zip_with(captions, paths, lambda c, p: F.struct(c.alias("caption"), p.alias("path")))
    return F.transform(pairs, lambda x, i: F.struct(
        F.concat(F.lit("fig"), (i + 1).cast("string")).alias("figure_id"),
        F.when(x["caption"] == "", F.concat(F.lit("Figure "), (i + 1).cast("string"))).otherwise(x["caption"]).alias("caption"), x["path"].alias("path")))


def numbered(items: Column, prefix: str) -> Column:
    """Strings as (id, text), numbered from 1."""
    return F.transform(items, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"), x.alias("text")))


#: All words of the primitives, the longest first. No two of them overlap but where one holds the other.
PRIMITIVE_WORDS = r"\b(" + "|".join(sorted({w for p in PRIMITIVES.values() for w in p[3:-3].split("|")}, key=lambda w: (-len(w), w))) + r")\b"


def primitives(text: Column, patterns: dict[str, str] = PRIMITIVES) -> Column:
    """Names of the primitives that occur, in the order of the table.

    The fixed words are taken from the text in one pass; their patterns then look at these words only.
    """
    low = F.lower(text)
    if patterns is PRIMITIVES:
        low = F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit(PRIMITIVE_WORDS), F.lit(1))), "|")
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def overlap_tokens(text: Column) -> Column:
    """Distinct lower-case words of more than two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def full_text(title: Column, categories: Column, abstract: Column, body: Column, references: Column, limit: int | None = None) -> Column:
    """Labelled parts with an empty line between; missing parts are left out; at most 20 references. ``limit``, in characters, is for encoders that take no more."""
    refs = F.when(F.coalesce(F.size(references), F.lit(0)) > 0, F.concat(F.lit("References: "), F.array_join(F.slice(references, 1, 20), "; ")))
    parts = F.concat_ws("\n\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Categories: "), F.array_join(categories, ", ")), F.concat(F.lit("Abstract: "), abstract), F.nullif(body, F.lit("")), refs)
    return parts if limit is None else F.substring(parts, 1, limit)


def mentions(text: Column, names: list[str]) -> Column:
    return any_of(F.lower(text), names)
