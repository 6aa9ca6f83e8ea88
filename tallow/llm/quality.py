"""Line-first quality rules, with DataFrame functions only.

Each line is judged (symbols, shouting, navigation, stutter, boilerplate, missing
punctuation, part of a menu of short lines); failing lines are removed; a document that loses too much
of its text is rejected. All of it runs inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import set_aside

# Phrases that mark a short line as boilerplate, in English, German, French and Spanish; a full stop stands for a letter with an accent.
PHRASES = (
    r"all rights reserved|cookie|privacy policy|terms of (use|service)|click here|subscribe|sign (in|up)|log ?in|javascript|copyright|read more|share (this|on)",
    r"alle rechte vorbehalten|datenschutzerkl.rung|impressum|nutzungsbedingungen|hier klicken|jetzt abonnieren|jetzt anmelden|weiterlesen|diese seite teilen",
    r"tous droits r.serv.s|politique de confidentialit|conditions d.utilisation|mentions l.gales|cliquez ici|abonnez-vous|se connecter|lire la suite|partager (cet|sur)",
    r"todos los derechos reservados|pol.tica de privacidad|t.rminos de uso|aviso legal|haga clic|haz clic|suscr.bete|iniciar sesi.n|leer m.s|compartir en",
)
BOILERPLATE = "(?i)" + "|".join(PHRASES)
SENTENCE_MARK = r"[.!?;:…。！？]"
# A menu: so many lines in a row of one or two words each, without a mark.
MENU_LINES, MENU_WORDS = 5, 2
SYMBOL = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_words", "clean_text", "base_failed", "kept"]

# A word that the same word follows.
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _line_fails(text: Column, n: Column) -> Column:
    """True if one of the rules rejects a line of n words. A line without words never fails."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    noisy = count(SYMBOL) * 4 > n
    shouting = (n >= 3) & ((count("!") * 3 > n) | ((F.upper(text) == text) & (F.lower(text) != text)))
    navigation = (n >= 3) & (count("[|»›•→]") * 4 > n)
    boilerplate = (n <= 12) & text.rlike(BOILERPLATE)
    unpunctuated = (n >= 8) & ~text.rlike(SENTENCE_MARK)
    stutter = (n >= 5) & (count(STUTTER) * 5 > n)
    return (n > 0) & (noisy | shouting | navigation | boilerplate | unpunctuated | stutter)


def _in_menu(lines: Column) -> Column:
    """For each line (text, n words), whether it stands in a stretch of MENU_LINES short ones or more. A line without words ends a stretch."""
    short = F.transform(lines, lambda x: x["n"].between(1, MENU_WORDS) & ~x["text"].rlike(SENTENCE_MARK + "|,"))
    # The lines as letters: an s that has MENU_LINES - 1 more around it, at every split of them before and after.
    letters = F.array_join(F.transform(short, lambda x: F.when(x, "s").otherwise("o")), "")
    around = "|".join(f"(?<=s{{{k}}})s(?=s{{{MENU_LINES - 1 - k}}})" for k in range(MENU_LINES))
    return F.transform(F.regexp_extract_all(F.regexp_replace(letters, around, "m"), F.lit("."), F.lit(0)), lambda x: x == "m")


def apply_quality_rules(docs: DataFrame, max_loss: float = 0.4, min_words: int = 50, max_repeat: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with the figures of each whole text and a verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_words,
    clean_text, base_failed and kept. kept is false for base_failed documents and for those whose
    failing lines hold more than max_loss of their words. Null and empty texts have no words, fail the
    base rules and have an empty clean_text; very long ones are judged whole. Repeated rows are judged alike, a
    table without rows gives none. Other columns pass through; those named like a new one are replaced.
    """
    given, names = set_aside(docs)
    t = F.coalesce(F.col(names[text_col]), F.lit(""))
    base = given.withColumn("_t", t).withColumn("_w", words_of(F.col("_t")))
    # Windows of three words, as 64-bit hashes in text order.
    rest = lambda k: F.slice(F.col("_w"), F.lit(k), F.greatest(F.size("_w") - 2, F.lit(0)))
    base = base.withColumn("_windows", F.zip_with(F.zip_with(rest(1), rest(2), lambda a, b: F.xxhash64(a, b)), rest(3), lambda x, c: F.xxhash64(x, c)))
    # Where a window may repeat: the hash less the bits that its position needs, with the position in one long, sorted so that
    # equal ones meet. That finds each repeated window and, in very long texts, a few others.
    base = base.withColumn("_bits", F.length(F.bin(F.size("_windows"))))
    pack = lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<bigint>")
    base = base.withColumn("_packed", F.when(repeats, F.sort_array(F.transform("_windows", pack))).otherwise(none))
    high = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    low = lambda x: x - F.call_function("shiftleft", high(x), F.col("_bits"))
    after = lambda name: F.slice(name, F.lit(2), F.greatest(F.size(name) - 1, F.lit(0)))
    meet = F.zip_with("_packed", after("_packed"), lambda x, y: F.when(high(x) == high(y), F.array(low(x), low(y))))
    base = base.withColumn("_spots", F.array_distinct(F.flatten(F.filter(meet, lambda x: x.isNotNull()))))
    # The whole hashes at those places decide.
    whole = F.transform("_spots", lambda i: F.struct(F.element_at("_windows", (i + 1).cast("int")).alias("h"), i.alias("i")))
    base = base.withColumn("_whole", F.sort_array(whole))
    meet = F.zip_with("_whole", after("_whole"), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    base = base.withColumn("_spots", F.sort_array(F.array_distinct(F.flatten(F.filter(meet, lambda x: x.isNotNull())))))
    covered = F.aggregate(F.zip_with("_spots", after("_spots"), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    base = base.withColumn("n_repeat_words", covered)
    base = base.withColumn("_lines", F.transform(F.split("_t", "\n"), lambda x: F.struct(x.alias("text"), F.size(words_of(x)).alias("n"))))
    judged = lambda x, menu: F.struct(x["text"].alias("text"), x["n"].alias("n"), (menu | _line_fails(x["text"], x["n"])).alias("bad"))
    base = base.withColumn("_lines", F.zip_with("_lines", _in_menu(F.col("_lines")), judged))
    base = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOL)).cast("long"),
            "_with_words": F.transform(F.filter("_lines", lambda x: x["n"] > 0), lambda x: x["text"]),
            "n_bad_lines": F.size(F.filter("_lines", lambda x: x["bad"])).cast("long"),
            "lost_words": F.aggregate(F.filter("_lines", lambda x: x["bad"]), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]),
            "clean_text": F.array_join(F.transform(F.filter("_lines", lambda x: ~x["bad"]), lambda x: x["text"]), "\n"),
        }
    )
    base = base.withColumn("n_dup_lines", (F.size("_with_words") - F.size(F.array_distinct("_with_words"))).cast("long"))
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words")))
    base = base.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.lit(max_loss) * F.col("n_words")))
    return base.select(*[F.col(given).alias(c) for c, given in names.items() if c not in ADDED], *ADDED)


def clean_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The kept documents with their failing lines removed; columns of docs, whatever their names. A column n_chars follows the new text."""
    # The filter must stay above the figures: pushed into them, it would repeat their whole chain of expressions
    # for each use. A condition on a column that is not deterministic (and always true) holds it there.
    given, names = set_aside(docs)
    judged = apply_quality_rules(given, text_col=names[text_col], **options).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.where(F.col("kept") & (F.col("_row") >= 0))
    new = {text_col: F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[new.get(c, F.col(x)).alias(c) for c, x in names.items()])
