"""Chunkers: sentence windows, budget groups with carried overlap, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T


def windows(items: Column, size: int, stride: int) -> Column:
    """Slices of ``size`` items, ``stride`` apart; the last may be shorter, no start lies beyond the end."""
    cut = lambda xs: F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(stride)), lambda i: F.slice(xs, i, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))
    return T.let(items, cut)


def sentence_windows(df: DataFrame, text: str, size: int = 3, stride: int = 2, least: int = 8) -> DataFrame:
    """One row (chunk_index, chunk) for each window of sentences with at least ``least`` words."""
    chunks = df.select("*", F.posexplode(windows(T.sentences(F.col(text)), size, stride)).alias("chunk_index", "w"))
    return chunks.withColumn("chunk", F.array_join("w", " ")).drop("w").filter(T.word_count(F.col("chunk")) >= least)


def budget_groups(items: Column, budget: int, overlap: int = 1) -> Column:
    """Greedy groups of whole items within a budget of words.

    A full group is emitted and its last ``overlap`` items open the next one, so
    a group may exceed the budget by what it carries; an oversize item that
    opens a group stands alone. This is no running sum: the state is folded over
    the array. The items of one row are all that is held.
    """
    words = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + T.word_count(x))
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = T.word_count(x)
        alone = (n > budget) & (F.size(s["open"]) == 0)
        full = (s["n"] + n > budget) & (F.size(s["open"]) > 0)
        carried = F.slice(s["open"], F.greatest(F.lit(1), F.size(s["open"]) - F.lit(overlap - 1)), F.lit(overlap)) if overlap else empty
        one = F.array(x)
        return (
            F.when(alone, F.struct(F.concat(s["done"], F.array(one)).alias("done"), s["open"].alias("open"), s["n"].alias("n")))
            .when(full, F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.concat(carried, one).alias("open"), (words(carried) + n).alias("n")))
            .otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], one).alias("open"), (s["n"] + n).alias("n")))
        )

    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def budget_tokens(chars: int) -> int:
    """Words that a budget of characters stands for: 5.5 to a word, 100 at least."""
    return max(100, round(chars / 5.5))


#: Section headings and their aliases; a phrase of several words also counts inside a line.
SECTIONS = {
    "summary": ["summary", "professional summary", "about", "profile", "overview", "objective", "career objective", "introduction", "bio", "about me", "career summary", "personal statement", "executive summary"],
    "skills": ["skills", "technical skills", "technologies", "core skills", "stack", "tech stack", "tools and technologies", "programming languages", "expertise", "competencies", "key skills", "technical proficiencies", "areas of expertise"],
    "work_experience": ["work experience", "experience", "professional experience", "employment", "career history", "employment history", "work history", "positions held", "relevant experience", "internships", "work", "career"],
    "education": ["education", "academics", "academic background", "qualifications", "educational background", "degrees", "schooling"],
    "projects": ["projects", "selected projects", "portfolio", "personal projects", "open source", "side projects", "notable projects", "technical projects"],
    "certifications": ["certifications", "certification", "licenses", "certificates", "professional certifications", "credentials", "courses"],
    "achievements": ["achievements", "awards", "honors", "accomplishments", "recognition", "publications"],
}
#: Words of a section that isn't cut again, and of the pieces of a longer one.
WHOLE_SECTION, SECTION_PIECE = 600, 400


def clean_lines(text: Column) -> Column:
    """Line feeds for all line ends, without white space around the text."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """What blank lines part; trimmed, empty ones dropped."""
    return _parts(text, r"\n{2,}")


def units(text: Column) -> Column:
    """Lines; those of more than 30 words are cut where a sentence ends before a capital, a quote or a bracket."""
    cut = lambda line: F.when(T.word_count(line) <= 30, F.array(line)).otherwise(_parts(line, r"(?<=[.!?])\s+(?=[A-Z\u00C0-\u024F\u1E00-\u1EFF\"'(])"))
    return F.flatten(F.transform(_parts(text, r"\n"), cut))


def budget_chunks(text: Column, budget: int = 800, overlap: int = 1) -> Column:
    """Chunks of whole paragraphs within a budget of words; a paragraph beyond it is first cut into groups of sentences."""

    def split(p: Column) -> Column:
        groups = T.let(budget_groups(_parts(p, r"(?<=[.!?])\s+"), budget, 0), lambda g: F.transform(g, lambda s: F.array_join(s, " ")))
        return F.when(T.word_count(p) > budget, groups).otherwise(F.array(p))

    pieces = F.flatten(F.transform(paragraphs(clean_lines(text)), split))
    return F.transform(budget_groups(pieces, budget, overlap), lambda g: F.array_join(g, "\n\n"))


def heading(line: Column) -> Column:
    """The section that a line announces, ``unknown_section`` for a short line in capitals, or null."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[^a-zA-Z ]+", " "), r"\s+", " ")))
    holds = lambda names: [F.contains(plain, F.lit(n)) for n in names if " " in n]
    known = F.coalesce(*[F.when(reduce(Column.__or__, [plain.isin(*names), *holds(names)]), F.lit(section)) for section, names in SECTIONS.items()])
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    shout = (letters > 0) & (capitals >= 0.85 * letters) & (T.word_count(line) <= 5) & ~F.contains(line, F.lit("."))
    return F.when((F.length(line) > 80) | (plain == ""), F.lit(None).cast("string")).when(known.isNotNull(), known).when(shout, F.lit("unknown_section"))


def section_parts(text: Column) -> Column:
    """(section, body) in order: the lines under the last heading of at most six words before them; bodies of fewer than five words are dropped. The lines of one text are all that is held."""
    start = F.array(F.struct(F.lit("preamble").alias("section"), F.array().cast("array<string>").alias("lines")))

    def step(s: Column, line: Column) -> Column:
        def add(head: Column) -> Column:
            last = F.element_at(s, -1)
            longer = F.struct(last["section"].alias("section"), F.concat(last["lines"], F.array(line)).alias("lines"))
            opened = F.array(F.struct(head.alias("section"), F.array().cast("array<string>").alias("lines")))
            return F.when(head.isNotNull() & (T.word_count(line) <= 6), F.concat(s, opened)).otherwise(F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(longer)))

        return T.let(heading(line), add)

    folded = F.aggregate(_parts(clean_lines(text), r"\n"), start, step)
    bodies = F.transform(folded, lambda x: F.struct(x["section"].alias("section"), F.array_join(x["lines"], "\n").alias("body")))
    return F.filter(bodies, lambda x: T.word_count(x["body"]) >= 5)


def section_chunks(text: Column) -> Column:
    """(section, chunk): sections, longer ones cut into pieces."""
    pieces = lambda x: F.when(T.word_count(x["body"]) <= WHOLE_SECTION, F.array(x["body"])).otherwise(budget_chunks(x["body"], SECTION_PIECE, 1))
    return F.flatten(F.transform(section_parts(text), lambda x: F.transform(pieces(x), lambda c: F.struct(x["section"].alias("section"), c.alias("chunk")))))


def document_chunks(df: DataFrame, text: str, chars: int = 1200, overlap: int = 150, fine: bool = True, size: int = 3, stride: int = 2, least: int = 8) -> DataFrame:
    """Rows (chunk_index, chunk, strategy, section): paragraphs within the budget, then (``fine``) windows of sentences and sections; of equal chunks the first stays."""
    one = lambda xs, strategy: F.transform(xs, lambda c: F.struct(c.alias("chunk"), F.lit(strategy).alias("strategy"), F.lit(None).cast("string").alias("section")))
    body = clean_lines(F.col(text))
    parts = [one(budget_chunks(F.col(text), budget_tokens(chars), 1 if overlap > 0 else 0), "paragraph")]
    if fine:
        spans = F.filter(F.transform(windows(units(body), size, stride), lambda w: F.array_join(w, " ")), lambda c: T.word_count(c) >= least)
        parts += [one(spans, "sentence_window"), F.transform(section_chunks(F.col(text)), lambda x: F.struct(x["chunk"].alias("chunk"), F.lit("section").alias("strategy"), x["section"].alias("section")))]
    first = lambda xs: F.filter(xs, lambda x, i: (F.trim(x["chunk"]) != "") & (F.array_position(F.transform(xs, lambda y: F.trim(y["chunk"])), F.trim(x["chunk"])) == i + 1))
    return df.withColumn("all", F.concat(*parts)).select(*df.columns, F.posexplode(first(F.col("all"))).alias("chunk_index", "c")).select(*df.columns, F.col("chunk_index").cast("long").alias("chunk_index"), "c.*")


def sections(df: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, part, section, body): lines under the last heading before them; bodies of fewer than ``least`` words are dropped."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).withColumn("head", heading(F.col("line")))
    so_far = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("part", F.count("head").over(so_far)).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(so_far), F.lit("preamble")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    grouped = placed.filter("head IS NULL AND line <> ''").groupBy(key, "part", "section").agg(body.alias("body"))
    return grouped.filter(T.word_count(F.col("body")) >= least)
