"""Line-first cleaning with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import WORD, count_words, dropped, let, stored, without, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A line fails if more than this share of its characters (white space apart) are neither letters nor digits,
MAX_MARKS = 0.2
#: or more than this share of them are no letters (lines of FEW_WORDS words and more),
MAX_OTHERS, FEW_WORDS = 0.7, 3
#: or this share of its words are separators,
MAX_SEPARATORS = 0.2
#: or it lies in a run of so many consecutive lines of at most SHORT words each, none of which ends as a sentence,
RUN, SHORT = 4, 5
#: or it has at most PHRASE_WORDS words, a boilerplate phrase among them,
PHRASE_WORDS = 40
#: or it has at most STOCK_WORDS words, doesn't end as a sentence and stands in STOCK_TEXTS different texts of the corpus.
STOCK_WORDS, STOCK_TEXTS = 12, 10
#: Stock lines that are compared in place, as hashes in the plan; more are joined.
FEW_STOCK = 2000
#: Phrases in English, German, French and Spanish.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie", "subscribe to", "sign in", "log in", "enable javascript", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "jetzt anmelden", "impressum",
    "tous droits réservés", "politique de confidentialité", "conditions d’utilisation", "conditions d'utilisation", "mentions légales", "se connecter", "s’abonner", "s'abonner",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "iniciar sesión", "suscríbete",
)
BOILERPLATE = "(?iu)" + "|".join(PHRASES)
SEPARATOR = r"(?<![^\x20\x09-\x0D])[|>»·•/–—-]+(?![^\x20\x09-\x0D])"
MARK = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"
OTHER = r"[^\p{L}\p{M}\x20\x09-\x0D]"
#: How sentences end: a terminal mark, then quotes or brackets, then white space.
TERMINAL = r"[.!?…。！？][\x22\x27”’»)\]]*[\x20\x09-\x0D]*$"
#: A document may lose this share of its characters (white space apart).
MAX_LOSS = 0.5


def _solid(text: Column) -> Column:
    """Code points outside white space."""
    return (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def repeated_words(text: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text; hashes are sorted, so long texts stay n log n."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(row: Column) -> Column:
        same = F.filter(row, lambda x, i: (F.get(row, i - 1)["h"] == x["h"]) | (F.get(row, i + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(same, lambda x: x["p"])), covered)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    def judged(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(ordered, twice))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda hashes: F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows(hashes), judged))).cast("long")


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def open_ended(line: Column, most: int) -> Column:
    """Whether a line has 1 to `most` words and doesn't end as a sentence; what is cheap to ask comes first."""
    return (F.char_length(line) <= 40 * most) & ~F.endswith(line, F.lit(".")) & _n_words(line).between(1, most) & ~F.rlike(line, F.lit(TERMINAL))


def line_fails(line: Column) -> Column:
    """The rules that look at one line alone: punctuation, letters, separators, phrases; a line without words never fails."""

    def judged(m: Column) -> Column:
        n, solid, marks = m["n"], m["solid"], m["marks"]
        # Separators are marks, so that most lines have too few of these for the slower expression to be asked.
        separators = (marks > MAX_SEPARATORS * n) & (F.regexp_count(line, F.lit(SEPARATOR)) > MAX_SEPARATORS * n)
        letters = (n >= FEW_WORDS) & (F.regexp_count(line, F.lit(OTHER)) > MAX_OTHERS * solid)
        return (marks > MAX_MARKS * solid) | letters | separators | ((n <= PHRASE_WORDS) & F.rlike(line, F.lit(BOILERPLATE)))

    measured = F.struct(_n_words(line).alias("n"), _solid(line).alias("solid"), F.regexp_count(line, F.lit(MARK)).alias("marks"))
    return F.rlike(line, F.lit(WORD)) & let(measured, judged)


def in_menu(short: Column, i: Column) -> Column:
    """Whether place i of a boolean array lies in RUN consecutive true ones."""
    at = lambda k: F.coalesce(F.get(short, i + k), F.lit(False))
    return F.when(F.get(short, i), reduce(or_, (reduce(and_, (at(k) for k in range(first, first + RUN) if k)) for first in range(1 - RUN, 1)))).otherwise(False)


def stock_lines(df: DataFrame, text: str = "text") -> tuple[list[int], DataFrame | None]:
    """The open-ended lines that STOCK_TEXTS different texts or more share: (their hashes, None) if they are few.

    Else ([], marks): a row (t, flags) per text hash t with such lines, where flags tells by place which lines they are, up
    to the last. Hashes and places are all that is shuffled; a text's marks are no more than its lines.
    """
    found = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.when(open_ended(x, STOCK_WORDS), F.struct(i.alias("i"), F.xxhash64(x).alias("h")))), lambda x: x.isNotNull())
    lines = df.select(F.xxhash64(text).alias("t"), F.explode(found).alias("x")).select("t", "x.i", "x.h").distinct()
    stock = stored(lines.select("t", "h").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK_TEXTS).select("h"))
    few = [r["h"] for r in stock.limit(FEW_STOCK + 1).collect()]
    if len(few) <= FEW_STOCK:
        dropped(stock)
        return few, None
    places = F.array_sort(F.collect_list("i"))
    flags = let(places, lambda at: F.flatten(F.transform(at, lambda p, k: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1), F.array(F.lit(True))))))
    return [], lines.join(stock, "h").groupBy("t").agg(flags.alias("flags"))


def clean_lines(df: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """df with its counts, verdict and cleaned_text: failing lines go, then documents that lost too much are rejected.

    base_failed: fewer than 20 words, or over 30 % of words in repeated 8-word windows. kept: the base holds and the
    failing lines have at most max_loss of the text's characters. Lines are judged inside each row by punctuation,
    letters, separators and phrases, by the run of menu-like lines they lie in, and by how many different texts of the
    table hold them, a fixed number at every size. Those counts shuffle hashes of short open-ended lines; where more than
    FEW_STOCK lines are stock, the texts are joined with their marks by hash, and a text with very many copies is left to
    the adaptive skew join. So a hot source costs no more than other rows; time grows as n log n in a text's words. Null and empty texts have zero counts and fail the base; cleaned_text is then empty.
    Repeated rows are judged alike. Columns of df with an output's name are replaced, all others are kept. An empty
    table gives no rows.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars", "base_failed", "kept", "cleaned_text")
    names = [c for c in without(df, *made)]
    stock, marks = stock_lines(df, text)
    body = F.coalesce(F.col(text), F.lit(""))
    if marks is not None:
        df = df.select(*names, F.xxhash64(text).alias("__hash")).join(marks.select(F.col("t").alias("__t"), F.col("flags").alias("__flags")), F.col("__hash") == F.col("__t"), "left")

    def judged(lines: Column) -> Column:
        """(line, bad) of each line."""
        if marks is not None:
            common = lambda x, i: F.coalesce(F.get(F.col("__flags"), i), F.lit(False))
        elif stock:
            common = lambda x, i: open_ended(x, STOCK_WORDS) & F.xxhash64(x).isin(stock)
        else:
            common = lambda x, i: F.lit(False)
        menu = F.transform(lines, lambda x: open_ended(x, SHORT))
        return let(menu, lambda m: F.transform(lines, lambda x, i: F.struct(x.alias("line"), (in_menu(m, i) | common(x, i) | line_fails(x)).alias("bad"))))

    def told(found: Column) -> Column:
        gone = F.aggregate(F.filter(found, lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + _solid(x["line"]))
        left = F.array_join(F.transform(F.filter(found, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
        worded = F.transform(F.filter(found, lambda x: F.rlike(x["line"], F.lit(WORD))), lambda x: x["line"])
        again = let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        return F.struct(gone.alias("gone"), left.alias("left"), again.alias("again"))

    out = df.select(
        *names,
        count_words(F.col(text)).alias("n_words"),
        _solid(body).alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_words(F.col(text)).alias("n_repeat_words"),
        F.explode(F.array(let(let(F.split(body, "\n"), judged), told))).alias("__told"),
    )
    out = out.select(*names, "n_words", "word_chars", "n_symbols", F.col("__told.again").alias("n_dup_lines"), "n_repeat_words", F.col("__told.gone").alias("removed_chars"), F.col("__told.left").alias("cleaned_text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.col("removed_chars") <= max_loss * F.col("word_chars"))})


def line_rules_report(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")
