"""Line-first quality rules, in DataFrame expressions only.

Every line is judged alone (punctuation, navigation, boilerplate and shouting rules); failing lines go, and a
document that loses too large a share of its words is rejected, as is one that fails the base statistics.
There is no shuffle: each row is decided from its own text.

Defined results: a null or empty text has no words, fails the base rule (fewer than ``min_words``) and keeps an
empty ``clean_text``; repeated rows each get their own row; very long texts are judged whole; an empty table gives
an empty result; columns of the input whose names clash with an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, WORD_BREAK, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    """Limits of the line and document rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_lost_share: float = 0.5
    max_symbols_per_word: float = 0.3
    max_separator_share: float = 0.25
    max_shout_share: float = 0.3
    caps_line_words: int = 5
    #: Only shorter lines can be boilerplate; a long line that names a licence is prose. The phrases are English, French,
    #: German and Spanish.
    boilerplate_line_chars: int = 250
    #: A line passes if a sentence ends in it: one of these, closing quotes and brackets aside, before a space or the end.
    terminal: str = ".!?…。！？।؟:;"
    closing: str = "\"'”’»)\\]"
    separators: str = "|»›→•·"
    boilerplate: str = (
        r"(?iu)©|\b(?:all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|"
        r"we use cookies|accept (?:all )?cookies|enable javascript|copyright \d{4}|subscribe to our newsletter|"
        r"click here to|sign up for our|powered by|lorem ipsum|"
        r"tous droits réservés|mentions légales|politique de confidentialité|conditions générales d|"
        r"nous utilisons des cookies|accepter (?:tous )?les cookies|abonnez-vous|cliquez ici|publié sous licence|"
        r"alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|wir verwenden cookies|"
        r"(?:alle )?cookies akzeptieren|newsletter abonnieren|hier klicken|lizenziert unter|veröffentlicht unter der|"
        r"todos los derechos reservados|aviso legal|política de (?:privacidad|cookies)|términos (?:y condiciones|de uso)|"
        r"(?:usamos|utilizamos) cookies|aceptar (?:todas )?las cookies|suscríbete|haz clic aquí|publicado bajo licencia)"
    )
    navigation: str = (
        r"(?iu)^\s*(home|menu|search|log ?in|sign ?in|sign ?up|register|next|previous|back to top|read more|"
        r"share( this)?|tweet|contact( us)?|about( us)?|sitemap|skip to content|"
        r"accueil|rechercher?|connexion|se connecter|s['’]inscrire|suivant|précédent|retour en haut|lire la suite|"
        r"partager|à propos|plan du site|aller au contenu|"
        r"startseite|menü|suchen?|anmelden|registrieren|weiter(lesen)?|zurück|nach oben|mehr lesen|teilen|kontakt|"
        r"über uns|impressum|datenschutz|zum inhalt springen|"
        r"inicio|menú|buscar|iniciar sesión|registrarse|siguiente|anterior|volver arriba|leer más|compartir|contacto|"
        r"sobre nosotros|mapa del sitio|ir al contenido)\s*$"
    )


DEFAULT = LineRules()


def _regex_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fault(line: Column, rules: LineRules = DEFAULT) -> Column:
    """The name of the first rule that a line breaks, null for a sound or blank line."""
    n = _regex_count(line, WORD)
    symbols = F.length(line) - F.length(F.regexp_replace(line, f"[{SYMBOLS}]+", ""))
    separators = F.length(line) - F.length(F.regexp_replace(line, f"[{rules.separators}]+", ""))
    # Plain substring searches keep most lines from the costlier patterns that count.
    odd = reduce(or_, [F.contains(line, F.lit(c)) for c in SYMBOLS + rules.separators.replace("|", "")])
    loud = reduce(or_, [F.contains(line, F.lit(a + b)) for a in "!?" for b in "!?"])
    short = F.length(line) <= rules.boilerplate_line_chars
    return (
        F.when(~line.rlike(WORD), F.lit(None).cast("string"))
        .when(odd & (separators >= 2) & (separators > n * rules.max_separator_share), "navigation")
        .when(odd & (symbols > n * rules.max_symbols_per_word), "symbols")
        .when(loud & (_regex_count(line, "[!?]{2,}") > n * rules.max_shout_share) | ~line.rlike(r"[a-z]|\p{Ll}|\p{Lo}") & (n >= rules.caps_line_words), "shouting")
        .when(short & line.rlike(rules.navigation), "navigation")
        .when(short & line.rlike(rules.boilerplate), "boilerplate")
        .when(~line.rlike(f"[{rules.terminal}][{rules.closing}]*({WORD_BREAK}|$)"), "punctuation")
    )


def window_hashes(word_array: str) -> Column:
    """A hash of each window of the word array; null where there are fewer than two windows."""
    last = F.size(word_array) - WINDOW + 1
    return F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(word_array, i, WINDOW))))


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word array _w and the window hashes _h: words in ``WINDOW``-word windows found twice or more, the first included.

    Windows are compared by a 64-bit hash; a hash set over a flat long array settles the many texts without any
    repeat, and only the others sort (hash, place) pairs and compare the words of neighbours with equal hashes.
    """
    pairs = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    df = df.withColumn("_pairs", pairs)

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice("_w", a["i"] + 1, WINDOW) == F.slice("_w", b["i"] + 1, WINDOW))

    at = lambda i: F.get(F.col("_pairs"), i)
    places = F.array_compact(F.transform("_pairs", lambda p, k: F.when(F.coalesce(same(p, at(k - 1)), F.lit(False)) | F.coalesce(same(p, at(k + 1)), F.lit(False)), p["i"])))
    df = df.withColumn("_places", F.when(F.col("_pairs").isNotNull(), F.sort_array(places)))
    steps = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), k + 1) - p, F.lit(WINDOW))).cast("long"))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_pairs", "_places", "_h")


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_words", "faults", "kept", "clean_text")


def quality_rules(docs: DataFrame, rules: LineRules = DEFAULT, text: str = "text") -> DataFrame:
    """All of ``docs`` with the statistics, faults by line, verdict ``kept`` and ``clean_text`` without failed lines."""
    df = docs.select(*[docs[c] for c in docs.columns if c == text or c not in OUTPUT])
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_w": words(F.col("_t")), "_lines": F.split("_t", "\n")})
    df = df.withColumns({"_h": window_hashes("_w"), "_full": F.filter("_lines", lambda x: x.rlike(WORD)), "_faults": F.transform("_lines", lambda x: line_fault(x, rules))})
    df = with_repeated_words(df)
    bad = F.filter("_lines", lambda x, i: F.get(F.col("_faults"), i).isNotNull())
    good = F.filter("_lines", lambda x, i: F.get(F.col("_faults"), i).isNull())
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_lines": F.size("_full").cast("long"),
            "faults": F.array_compact("_faults"),
            "lost_words": F.regexp_count(F.array_join(bad, "\n"), F.lit(WORD)).cast("long"),
            "clean_text": F.array_join(good, "\n"),
        }
    )
    df = df.withColumns(
        {
            "n_bad_lines": F.size("faults").cast("long"),
            "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        }
    )
    # The row number, which depends on where a row stands, keeps the optimizer from pushing a filter on ``kept`` below the
    # columns that it is made of, where their expressions would be written out once for every use.
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= rules.max_lost_share * F.col("n_words")) & here)
    return df.drop("_t", "_w", "_lines", "_full", "_faults")


def cleaned_documents(docs: DataFrame, rules: LineRules = DEFAULT, text: str = "text") -> DataFrame:
    """The documents that are kept, with ``clean_text``."""
    return quality_rules(docs, rules, text).where("kept")


def quality_report(docs: DataFrame, rules: LineRules = DEFAULT) -> DataFrame:
    """The digest of the contract, one row per input row."""
    return quality_rules(docs.select("doc_id", "text"), rules).select("doc_id", *[c for c in OUTPUT if c not in ("clean_text", "faults")])
