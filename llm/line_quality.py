"""Operator 4: line-first quality rules, in DataFrame functions only.

Every line is judged first: by its punctuation (mostly signs, or a short line without an end mark), as navigation (menu
separators, menu words) and as boilerplate (legal, cookie and template phrases). Lines that fail go, and a document that loses more than
``MOST_LOST`` of the characters in its words is rejected, as is one that fails the base rules: too few words, or too many words in
five-word windows that occur more than once.

Everything is worked out inside a row with array functions: no shuffle, no explosion. Windows are compared by a 64-bit hash of
their words' 64-bit hashes, within one document only.

Null, empty and blank texts have no words: all counts are 0, the base fails, the document is not kept. Ids are passed through,
null or repeated; columns beside the named ones are not read. An empty table gives no rows. A very long text, or line, is read by patterns that
neither recurse nor go back over what they have matched, in time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, MOST_REPEATED, WINDOW, MOST_LOST = 10, 20, 5, 0.8

# Rules of the method.
SYMBOLS = r"[#*$%&|<>]"
SPACES, WORD = r"[ \t-\r]+", r"[^ \t-\r]+"
END_MARK = r"[.!?:;…。！？؟।\"'”’»«)\]][ \t-\r]*$"
# Java matches a repeated group by recursion, which a long run of separators or entries would take beyond a thread's stack. So no group
# is repeated in the rules for Spark: a class is, and of a menu the first entry is enough.
SEPARATORS = r"(^|[ \t-\r])[|>›»•·/→]++([ \t-\r]|$)"
# Menu words and template phrases in English, German, French and Spanish. Letters with accents are given in both cases, because the two
# engines differ in which of them they take for the same.
_MENU_WORDS = (
    "home", "menu", "login", "log in", "sign in", "sign up", "search", "contact( us)?", "about( us)?", "next", "previous", "back to top",
    "skip to content", "share", "read more", "site ?map",
    "startseite", "anmelden", "abmelden", "registrieren", "suchen?", "kontakt", "impressum", "[üÜ]ber uns", "weiter", "zur[üÜ]ck", "nach oben",
    "zum inhalt springen", "teilen", "weiterlesen", "mehr lesen", "[üÜ]bersicht",
    "accueil", "connexion", "se connecter", "s'inscrire", "recherche(r)?", "nous contacter", "[àÀ] propos", "suivant", "pr[éÉ]c[éÉ]dent", "haut de page",
    "partager", "lire la suite", "plan du site", "aller au contenu",
    "inicio", "iniciar sesi[óÓ]n", "registrarse", "buscar", "contacto", "acerca de", "sobre nosotros", "siguiente", "anterior", "volver arriba",
    "compartir", "leer m[áÁ]s", "mapa del sitio", "ir al contenido")
MENU = rf"(?i)^[ \t-\r]*(({'|'.join(_MENU_WORDS)})([ \t-\r]*[|>/»•·][ \t-\r]*|[ \t-\r]*$))"
_PHRASES = (
    "all rights reserved", "copyright ©", r"\(c\) [0-9]{4}", "privacy policy", "terms of (use|service)", "cookie", "javascript", "lorem ipsum",
    "licensed under", "permission is hereby granted", "subscribe to our", "click here",
    "alle rechte vorbehalten", "datenschutzerkl[äÄ]rung", "nutzungsbedingungen", "allgemeine gesch[äÄ]ftsbedingungen", "lizenziert unter",
    "newsletter abonnieren", "hier klicken", "klicken sie hier",
    "tous droits r[éÉ]serv[éÉ]s", "politique de confidentialit[éÉ]", "conditions d.utilisation", "mentions l[éÉ]gales", "sous licence", "abonnez-vous",
    "cliquez ici",
    "todos los derechos reservados", "pol[íÍ]tica de privacidad", "t[éÉ]rminos (de uso|y condiciones)", "condiciones de uso", "aviso legal",
    "bajo licencia", "suscr[íÍ]bete", "haga clic aqu[íÍ]")
PHRASES = rf"(?i)({'|'.join(_PHRASES)})"
LONGEST_BOILERPLATE = 400  # characters; a longer line is prose that mentions such a phrase


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which occurs twice or more in the array."""
    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(places, lambda i: F.struct(
            F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def counted(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: same(F.get(ordered, k + 1), x) | same(F.get(ordered, k - 1), x))
        return let(F.sort_array(twice["p"]), covered)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(F.sort_array(windows(h)), counted))).cast("bigint")


def line_state(line: Column) -> Column:
    """(chars, fails) of a line: characters in its words, and whether it breaks a rule. Lines without words break none: they are the space
    between paragraphs."""
    def judged_line(s: Column) -> Column:
        odd_punctuation = (s["signs"] * 10 > s["chars"] * 3) | ((s["words"] < 4) & ~line.rlike(END_MARK))
        boilerplate = (F.length(line) <= LONGEST_BOILERPLATE) & line.rlike(PHRASES)
        broken = odd_punctuation | line.rlike(MENU) | boilerplate | let(
            count_of(line, SEPARATORS), lambda n: (n >= 2) & (n * 6 >= s["words"]))
        return F.struct(s["chars"].alias("chars"), ((s["chars"] > 0) & broken).alias("fails"))

    counts = F.struct(word_chars(line).alias("chars"), count_of(line, WORD).alias("words"),
                      F.length(F.regexp_replace(line, r"[\p{L}\p{N} \t-\r]", "")).alias("signs"))
    return let(counts, judged_line)


def line_fails(line: Column) -> Column:
    return line_state(line)["fails"]


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")).cast("bigint")


def measures(text: Column) -> Column:
    """All counts of a text as one struct; ``lost_chars`` are the characters in words of failed lines, ``failed`` tells which lines these are."""
    def measured(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    def added(states: Column, chars: Callable[[Column], Column]) -> Column:
        return F.aggregate(states, F.lit(0).cast("bigint"), lambda a, s: a + chars(s))

    def line_counts(lines: Column) -> Column:
        def counted(states: Column) -> Column:
            filled = F.filter(lines, lambda _, i: F.get(states, i)["chars"] > 0)
            return F.struct(
                let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                added(states, lambda s: F.when(s["fails"], s["chars"]).otherwise(F.lit(0).cast("bigint"))).alias("lost_chars"),
                added(states, lambda s: s["chars"]).alias("word_chars"), F.transform(states, lambda s: s["fails"]).alias("failed"))

        return let(F.transform(lines, line_state), counted)

    return F.struct(let(words_of(text), measured).alias("words"), let(F.split(text, "\n"), line_counts).alias("lines"),
                    count_of(text, SYMBOLS).alias("n_symbols"))


def base_failed(m: Column) -> Column:
    return (m["words"]["n_words"] < LEAST_WORDS) | (
        100 * m["words"]["n_repeat_words"] > MOST_REPEATED * m["words"]["n_words"])


def kept(m: Column) -> Column:
    return ~base_failed(m) & (m["lines"]["lost_chars"] <= m["lines"]["word_chars"] * MOST_LOST)


def judged(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept and lost_chars."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    m = F.col("m")
    return documents.select(F.col(id_column).alias("doc_id"), measures(text).alias("m")).select(
        "doc_id", "m.words.n_words", "m.lines.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.words.n_repeat_words",
        base_failed(m).alias("base_failed"), kept(m).alias("kept"), "m.lines.lost_chars")


def clean(documents: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The kept documents, all columns as they were but for the text, which is left without the lines that failed.

    ``length_column``, if the table has it, becomes the length of the new text in code points where the text has changed.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = names[documents.columns.index(text_column)]
    plain = documents.toDF(*names)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = F.array_join(F.filter(F.split(whole, "\n"), lambda _, i: ~F.get("m.lines.failed", i)), "\n")
    # Out of a generator, the counts are worked out once; as a plain column, the filter would work them out again.
    verdict = plain.select(*names, F.explode(F.array(measures(whole))).alias("m")).where(kept(F.col("m")))
    changed = F.col("m.lines.lost_chars") > 0
    new = {text: F.when(changed, rest).otherwise(F.col(text))}
    if length_column in documents.columns:
        length = names[documents.columns.index(length_column)]
        new[length] = F.when(changed, F.length(rest).cast(documents.schema[length_column].dataType)).otherwise(F.col(length))
    return verdict.select(*[new.get(n, F.col(n)).alias(n) for n in names]).toDF(*documents.columns)


# The same rules for DuckDB; windows are compared as text there.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS all_lines FROM docs
), lines AS (
  SELECT rid, unnest(all_lines) AS line FROM split
), per_line AS (
  SELECT rid, line,
         len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) AS n_words,
         length(regexp_replace(line, '[ \t-\r]+', '', 'g')) AS n_chars,
         length(regexp_replace(line, '[\p{L}\p{N} \t-\r]', '', 'g')) AS signs,
         len(regexp_extract_all(line, '{separators}')) AS separators
  FROM lines
), failed AS (
  SELECT rid, sum(n_chars)::BIGINT AS lost_chars FROM per_line
  WHERE n_chars > 0 AND (signs * 10 > n_chars * 3
    OR (n_words < 4 AND NOT regexp_matches(line, '{end_mark}'))
    OR (separators >= 2 AND separators * 6 >= n_words)
    OR regexp_matches(line, '{menu}')
    OR (length(line) <= {longest} AND regexp_matches(line, '{phrases}')))
  GROUP BY rid
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM per_line WHERE n_chars > 0 GROUP BY rid
), windows AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT rid, sum(least(5, coalesce(after - i, 5)))::BIGINT AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM twice) GROUP BY rid
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM split LEFT JOIN dup USING (rid) LEFT JOIN repeats r USING (rid) LEFT JOIN failed USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= word_chars * 0.8 AS kept, lost_chars
FROM counted
"""
# The rules as DuckDB reads them, whose expressions have no possessive repetition and do not recurse.
SQL_SEPARATORS = r"(^|[ \t-\r])(\||>|›|»|•|·|/|→)+([ \t-\r]|$)"
SQL_MENU = MENU + "+"
for _name, _rule in (("separators", SQL_SEPARATORS), ("end_mark", END_MARK), ("menu", SQL_MENU), ("phrases", PHRASES),
                     ("longest", str(LONGEST_BOILERPLATE))):
    SQL = SQL.replace("{" + _name + "}", _rule.replace("'", "''"))
