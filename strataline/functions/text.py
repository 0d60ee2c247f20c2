"""Identifier, path and comment text as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOPWORDS = (
    "a an the is are was were be been being do does did done doing to of in on at by for from with without into onto over under up down out off "
    "and or but if then else when where which who whom whose what why how that this these those there here it its as so than too very can could "
    "should would will shall may might must i me my we our you your they them their he she him her not no yes about after before again all any "
    "both each few more most other some such only own same just also get gets got make makes made use used using find finds found work works "
    "way ways thing things want wants need needs please"
).split()
# Path segments that don't say what a file is for.
BORING = "src app lib main java com index dist core".split()
# Extensions parsed in full, those indexed as a whole, and those that only present.
FULL = ".js .jsx .mjs .cjs .ts .tsx .java .py .pyw .cs .php".split()
GENERIC = (
    ".html .htm .css .scss .sass .less .vue .svelte .ex .exs .rb .go .rs .c .h .cpp .cc .cxx .hpp .hh .kt .kts .swift .scala .dart .sh .bash .zsh .sql .pl .pm .lua .m .mm .groovy .hs .clj .cljs .graphql .gql .tf .fs .fsx .vb .r .elm "
    ".json .xml .yml .yaml .toml .ini .cfg .properties .env .gradle .csproj .sln .razor .cshtml .config"
).split()
PRESENTATION = ".html .htm .css .scss .sass .less .svg".split()
# Fixed value: file names that conventions of seven languages reserve for tests.
TEST_FILE = r"(^|/)__tests__/|\.(test|spec)\.[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.py$|(^|/)[^/]*Test\.java$|(^|/)Test[^/]*\.java$|_test\.go$|(^|/)[^/]*Tests?\.cs$|(^|/)[^/]*Test\.php$"
# Fixed value: words that show a question is about tests.
TEST_INTENT = r"(?i)\b(tests?|specs?|unit tests?|mocks?|mocking|coverage|karma|jasmine|jest|describe|assertions?|testing)\b"
MAX_PARTS, MIN_PART = 400, 2


def split_identifier(w: Column) -> Column:
    """encryptUsingAES256 to [encrypt, Using, AES, 256]; null stays null, empty gives an empty array."""
    s = F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda x: x != "")


def indexable_parts(w: Column) -> Column:
    return F.transform(F.filter(split_identifier(w), lambda x: F.length(x) >= MIN_PART), F.lower)


def is_compound(w: Column) -> Column:
    return F.size(split_identifier(w)) > 1


def identifier_parts(code: Column) -> Column:
    """The sub-words of each compound identifier, once per identifier in order of appearance, whole runs up to 400 words; the first run that doesn't fit ends it."""
    runs = F.filter(F.transform(F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))), is_compound), indexable_parts), lambda p: F.size(p) > 0)
    # lists are linear here; only the number of words is folded, not the words
    ends = F.aggregate(
        runs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full")),
        lambda a, p: F.struct(F.when(a["full"] | (a["n"] + F.size(p) > MAX_PARTS), a["n"]).otherwise(a["n"] + F.size(p)).alias("n"), F.when(a["full"] | (a["n"] + F.size(p) > MAX_PARTS), a["k"]).otherwise(a["k"] + 1).alias("k"), (a["full"] | (a["n"] + F.size(p) > MAX_PARTS)).alias("full")),
        lambda a: a["k"],
    )
    return F.coalesce(F.array_join(F.flatten(F.slice(runs, F.lit(1), ends)), " "), F.lit(""))


def stem(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def query_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)), stem))


def path_tokens(path: Column) -> Column:
    base = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"\.[A-Za-z0-9]+$", "")
    words = F.transform(F.flatten(F.transform(F.split(base, "/"), split_identifier)), F.lower)
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), stem))


def comment_words(doc: Column, most: int = 80) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(doc, F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS))), 1, most), " ")


def embedding_text(kind: Column, name: Column, path: Column, signature: Column, doc: Column) -> Column:
    words = F.lower(F.array_join(split_identifier(name), " "))
    base = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"\.[A-Za-z0-9]+$", "")
    segs = F.filter(F.split(base, "/"), lambda s: (s != "") & ~F.lower(s).isin(BORING))
    last = F.when(F.size(segs) > 3, F.slice(segs, -3, 3)).otherwise(segs)
    where = F.array_join(F.transform(last, lambda s: F.lower(F.array_join(split_identifier(s), " "))), " / ")
    text = F.concat(
        kind, F.lit(" "), name, F.when((words != "") & (words != F.lower(name)), F.concat(F.lit(" ("), words, F.lit(")"))).otherwise(""),
        F.when(where != "", F.concat(F.lit(" in "), where)).otherwise(""), F.lit(": "), F.coalesce(signature, F.lit("")), F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit(" - "), doc)).otherwise(""),
    )
    return F.left(text, F.lit(700))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_generic(ext: Column) -> Column:
    return ~F.lower(ext).isin(FULL)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]*)$", 1))


def repo_id(root: Column) -> Column:
    """slug-sha1[0:8] of a repository's path."""
    base = F.element_at(F.split(F.regexp_replace(root, "/+$", ""), "/"), -1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("repo")), F.lit("-"), F.left(F.sha1(root.cast("binary")), F.lit(8)))


def repo_name(root: Column, repo: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(root, r"[/\\]+$", ""), r"[/\\]"), -1), F.lit("")), repo)


def version_id(built_at: Column) -> Column:
    return F.date_format(F.coalesce(built_at, F.current_timestamp()), "yyyyMMdd'T'HHmmss'Z'")


def word_start(name: Column, q: Column) -> Column:
    """Some camelCase or snake_case word of name starts with q."""
    s = F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))
    return F.exists(F.split(s, "[^a-z0-9]+"), lambda w: w.startswith(q))


def ambiguity(n: Column) -> Column:
    return F.when(n > 1, 1 / F.sqrt(n.cast("double"))).otherwise(F.lit(1.0))


def cache_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def query_shape(text: Column) -> Column:
    """struct(lexical_first, reason, name_search, inner, tokens) of a question: a quoted literal, or one to three identifier-shaped words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    quoted = (F.length(t) > 2) & t.rlike("(?s)^([\"'`]).*\\1$")
    inner = F.when(quoted, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    tokens = F.regexp_extract_all(inner, F.lit("[A-Za-z0-9_$.]+"), F.lit(0))
    some = F.size(tokens) > 0
    ident = some & (F.size(tokens) <= 3) & (F.array_join(tokens, " ") == F.regexp_replace(inner, r"\s+", " ")) & F.forall(tokens, lambda w: w.rlike("[a-z][A-Z]|[_$.]|^[A-Z][a-z]+[A-Z]"))
    first = some & (quoted | ident)
    return F.struct(
        first.alias("lexical_first"), F.when(some & quoted, "quoted-literal").when(ident, "identifier").alias("reason"), F.when(first, (~quoted) | (F.size(tokens) == 1)).otherwise(F.lit(False)).alias("name_search"), inner.alias("inner"), tokens.alias("tokens")
    )


def rank_weight(kind: Column, path: Column, intent: Column) -> Column:
    """What a symbol is worth before ranking: tests are demoted unless the question is about tests, markup and styles always."""
    return kind_weight(kind, *path_flags(path), intent)


def path_flags(path: Column) -> tuple[Column, Column]:
    """Whether a path is a test's, and whether it only presents; false where it is null."""
    return F.coalesce(is_test_file(path), F.lit(False)), F.coalesce(extension(path).isin(PRESENTATION), F.lit(False))


def kind_weight(kind: Column, is_test: Column, presents: Column, intent: Column) -> Column:
    """rank_weight of a symbol whose path's flags are known."""
    k = F.when(kind.isin("test", "suite"), 0.35).when(kind == "hook", 0.5).when(kind == "file", 0.7).otherwise(1.0)
    w = F.when(intent, 1.0).when(F.coalesce(is_test, F.lit(False)), F.least(k, F.lit(0.35))).otherwise(k)
    return w * F.when(F.coalesce(presents, F.lit(False)), 0.6).otherwise(1.0)


def context_weight(kind: Column, path: Column) -> Column:
    """Priority of a hit in a bundle: by kind and by extension."""
    k = F.when(kind.isin("method", "function"), 1.0).when(kind == "class", 0.95).when(kind == "test", 0.6).when(kind == "suite", 0.55).when(kind == "hook", 0.5).when(kind == "file", 0.2).otherwise(0.8)
    e = F.coalesce(extension(path), F.lit(""))
    return k * F.when(e.isin(PRESENTATION), 0.25).when((e != "") & is_generic(e), 0.6).otherwise(1.0)


def indexed_parts(code: Column, doc: Column) -> Column:
    """What is indexed beside the code: the sub-words of its compound names, then the words of its comment."""
    return F.concat_ws(" ", F.nullif(identifier_parts(F.coalesce(code, F.lit(""))), F.lit("")), F.nullif(comment_words(doc), F.lit("")))
