"""Line-first quality rules.

Each line is judged before the document: by its punctuation, as navigation, and as boilerplate.
Lines that fail are removed, and a document that loses too much of its text with them is
rejected. Base rules on the whole text (too few words, too many repeated windows) come first. All
of it is one pass over the rows with array functions: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import SPACE, ascii_lower, words

SYMBOL = r"[#*$%&|<>]"
#: The end of a sentence: one of these marks behind a word, closing quotes and brackets aside.
END = r"[.!?:;…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
#: Phrases of page furniture in English, French, German and Spanish, lower case.
BOILERPLATE = [
    "cookie", "cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright", "licensed under",
    "enable javascript", "lorem ipsum", "click here", "sign up", "log in", "subscribe", "powered by",
    "politique de confidentialité", "mentions légales", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "se connecter",
    "abonnez-vous",
    "datenschutzerklärung", "nutzungsbedingungen", "impressum", "alle rechte vorbehalten", "hier klicken", "anmelden", "abonnieren",
    "política de privacidad", "aviso legal", "términos de uso", "todos los derechos reservados", "haga clic aquí", "iniciar sesión",
    "suscríbase",
]
#: A phrase with no letter or digit on either side.
PHRASE = r"(^|[^\p{L}\p{N}])(" + "|".join(BOILERPLATE) + r")($|[^\p{L}\p{N}])"
#: A line is boilerplate if it has a phrase for every so many words: a sentence that mentions one is not.
WORDS_A_PHRASE = 8
#: Separators between menu entries.
NAVIGATION = r"[|»›•·→]"


def _base(df: DataFrame) -> DataFrame:
    """Adds _words, _lines (those with a word), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column _text."""
    body = F.col("_text")
    three = lambda w, i: F.get(F.col("_words"), i + 1)
    four = lambda w, i: F.get(F.col("_words"), i + 2)
    df = df.withColumns({
        "_words": words(body),
        "_lines": F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # Starts of windows: all but the last two words.
        "_starts": F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
    }).withColumn("_hashes", F.transform("_starts", lambda w, i: F.xxhash64(w, three(w, i), four(w, i))))
    # Equal windows have equal hashes, so most texts are known to repeat nothing; the others compare the words.
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_starts", lambda w, i: F.struct(
            F.concat_ws(" ", w, three(w, i), four(w, i)).alias("w"), i.alias("i")))),
    ))
    around = lambda x, i: (x["w"] == F.get("_sorted", i - 1)["w"]) | (x["w"] == F.get("_sorted", i + 1)["w"])
    df = df.withColumn("_at", F.transform(
        F.filter("_sorted", lambda x, i: F.coalesce(around(x, i), F.get("_sorted", i + 1)["w"] == x["w"], F.lit(False))),
        lambda x: x["i"]))
    covered = F.array_distinct(F.concat(
        F.col("_at"), F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2)))
    return df.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), 0).otherwise(F.size(covered)).cast("long"))


def line_fails(line: Column, n: Column, max_symbols: float, min_line_words: int) -> Column:
    """Whether a line of ``n`` words breaks a rule; lines reach this with a word in them."""
    low = ascii_lower(line)
    punctuation = (
        # Many marks inside words, shouted words, or a long line in which no sentence ends.
        (F.regexp_count(line, F.lit(SYMBOL)) > n * max_symbols)
        | (F.regexp_count(line, F.lit(r"!!")) > n * max_symbols)
        | ((n >= min_line_words) & ~F.regexp_like(line, F.lit(END)))
    )
    navigation = F.regexp_count(line, F.lit(NAVIGATION)) * 4 > n
    boilerplate = (F.regexp_count(low, F.lit(PHRASE)) * WORDS_A_PHRASE >= n) & F.regexp_like(low, F.lit(PHRASE))
    return navigation | boilerplate | punctuation


def judge_quality(
    docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_symbols: float = 0.2,
    min_line_words: int = 30, max_loss: float = 0.5,
) -> DataFrame:
    """``docs`` with the base figures, cleaned, lost_chars, base_failed and kept.

    ``cleaned`` is the text of the lines that pass, each kept once where lines repeat. A document is kept if
    the base rules hold (at least ``min_words`` words, repeated windows cover at most ``max_repeat`` of them)
    and the lost lines hold at most ``max_loss`` of its characters in lines. A null text is a text without words: figures 0,
    base_failed, not kept. Rows do not depend on each other; repeated rows are judged alike. Columns named like a result are replaced, all
    others are kept, whatever their names; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "lost_chars")]
    # The caller's columns travel in one struct, so none of them can clash with the names used here.
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    df = _base(packed).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat))
    # Words of a line are counted once, not in each rule.
    df = df.withColumn("_counted", F.transform(F.array_distinct("_lines"), lambda x: F.struct(
        x.alias("line"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("n"))))
    df = df.withColumn("_good", F.transform(
        F.filter("_counted", lambda x: ~line_fails(x["line"], x["n"], max_symbols, min_line_words)), lambda x: x["line"]))
    df = df.withColumns({
        "cleaned": F.array_join("_good", "\n"), "_all": F.length(F.array_join("_lines", "")),
    }).withColumn("lost_chars", (F.col("_all") - F.length(F.array_join("_good", ""))).cast("long"))
    return df.select(
        *[F.col(f"row.`{c}`").alias(c) for c in own], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "cleaned",
        # The row number makes no difference to the verdict, but keeps a filter on it above the steps: pushed below, the
        # optimizer would write every step out in full for each of its uses.
        (~F.col("base_failed") & (F.col("lost_chars") <= F.col("_all") * max_loss)
         & (F.monotonically_increasing_id() >= 0)).alias("kept"),
    )
