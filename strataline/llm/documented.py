"""Functions paired with their documentation.

A symbol table of qualified names (repository, enclosing class, name, normalised signature) is built across files. Documented declarations without
body are joined to the definitions of the same qualified name and signature, overloads told apart by the signature. Only then the texts of each symbol are judged: its own
summary, the documentation inside its code, what its declaration says; the first that tells something beyond name and parameters is its description, and symbols
without any are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.session import materialize

KINDS = ["function", "method"]

# Documentation inside code, found by the JVM: what leads the code, or a doc string after a def line. Possessive, so that long code can't
# exhaust the stack.
_LEAD = r"(?s)^\s*+((?:(?:/\*.*?\*/|//[^\n]*+(?:\n|$)|#(?!\[)[^\n]*+(?:\n|$))\s*+)++)"
_DEF = r"(?s)^\s*+(?:@[^\n]*+\n\s*+)*+(?:async\s++)?def\s++\w++\s*+\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\s*+(?:->[^:\n]*+)?:[ \t]*+(?:#[^\n]*+)?\s*+[rRuU]?+"
_DOC3 = _DEF + r"(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')"


def doc_in_code(code: Column) -> Column:
    """The leading comment or the doc string of a piece of code; empty if there is none."""
    return F.trim(F.concat_ws("\n", F.regexp_extract(code, _LEAD, 1), F.regexp_extract(code, _DOC3, 1), F.regexp_extract(code, _DOC3, 2)))


_MARK = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+(?!\w)|///?!?|//+|#+(?!region|endregion|\w)|--+(?=\s|$)|\"\"\"|'''|<!--|-->)[ \t]?|[ \t]*(?:\*+/|-->)[ \t]*$", re.M)
_XML = re.compile(r"</?(?:summary|remarks|para|p|param|returns|c|code|see|inheritdoc|br|i|b|li|ul|value|example)\b[^<>]*/?>", re.I)
_INLINE = re.compile(r"\{@(?:inheritDoc|see|link|code)?\s*([^{}]*)\}", re.I)
_PARAM_XML = re.compile(r"<(param|returns|exception|typeparam)\b.*?</\1>", re.I | re.S)
_BLOCK_TAG = re.compile(r"(?:^|\s)[@\\](?:param|returns?|throws?|exception|see|since|author|version|deprecated|override|type|var|todo|inheritdoc|private|public|internal|api|link|yields?|arg(?:ument)?|prop(?:erty)?|typedef|template|constructor|class|static|async|function|method|name|memberof|package|license|copyright)\b.*", re.I | re.S)
_FIELD = re.compile(r"(?:^|\s):(?:param|type|return|returns|rtype|raises?)\b[^:]*:.*|^\s*(?:Args|Arguments|Parameters|Returns|Raises|Yields)\s*:\s*$.*", re.I | re.S | re.M)
_EMPTY = re.compile(
    r"\W*(?:(?:todo|fixme|xxx|hack|tbd|wip)\b.*|n/?a|none|null|nothing|see (?:above|below|there|also.*)|same as above|ditto|as above|no (?:description|documentation|comment|docs?)\b.*|(?:missing|add|needs?|write) (?:a )?(?:description|documentation|docs?|comment)s?(?: (?:here|later|for this|missing))?|description|documentation|undocumented|document (?:me|this).*|placeholder|lorem ipsum.*|"
    r"auto-?generated\b.*|generated (?:method|code|by)\b.*|(?:end)?region\b.*|#?(?:end)?region\b.*|noinspection\b.*|eslint[\- ].*|@?ts-(?:ignore|expect-error|nocheck).*|tslint:.*|istanbul .*|prettier-ignore.*|pylint:.*|noqa\b.*|type: ?ignore.*|pragma\b.*|nosonar.*|phpcs:.*|@?phpstan-.*|psalm-.*|jshint .*|coverage:.*|rubocop:.*|c8 ignore.*|biome-ignore.*|mypy:.*|flake8:.*|resharper .*|nolint.*|"
    r"(?:getter|setter|constructor|destructor|ctor|accessor|mutator|helper|util(?:ity)?|internal|private|public|deprecated|override)s?(?: (?:method|function))?|inherit(?:ed)?doc.*|\.\.\.)\W*",
    re.I | re.S,
)
_LICENCE = re.compile(r"\bcopyright\s*(?:\(c\)|©|\d{4}|by\b|the\b)|^\W*copyright\b|\blicen[sc]ed? under\b|\ball rights reserved\b|spdx-license|\bpermission is hereby granted\b|\bmit license\b|\bapache license\b|\bwithout (?:any )?warrant(?:y|ies)\b|\bany express or implied warrant", re.I)
_CODE = re.compile(
    r"^\W*(?:(?:return|if|for|while|const|let|var|import|from|def|function|public|private|throw|await|print|else|try|catch|switch|case|foreach|using|raise|elif|with|yield|assert|del)\b[^.!?]*[;{}()=\[\]:]+[^.!?]*|[\w$.>\[\]\-]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{:]?|[$\w.>\[\]\-]+\s*(?:[+\-*/|&]?=|=>|:=)\s*\S.*|[})\];]+|.*[;{}]\s*)$"
)
_SUB = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-öø-ÿ]+|\d+|[^\W\d_A-Za-z]+")
#: Words that say nothing about what a function does.
GENERIC = set(
    "the a an this that these those of for to is are be it its and or in on with by as at from into method function procedure routine helper class object constructor getter setter implementation implements implement does do performs perform executes execute handles handle handling operation "
    "calls call called returns return returned get gets set sets given specified value values parameter parameters param params argument arguments arg args result results description describe describes documentation used use uses using main simple basic new instance some any todo self void here there der die das des dem den ein eine einen methode funktion la le les un une el los las del de una metodo función fonction méthode".split()
)


def stem(w: str) -> str:
    for end in ("ing", "ies", "ers", "ed", "es", "er", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    w = w[:-1] if len(w) > 4 and w[-1] in "ey" else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def words(text: str) -> list[str]:
    return [w.lower() for w in _SUB.findall(text)]


def clean(doc: str | None) -> str:
    """The prose of a comment: markers, tags and directives removed, blanks joined."""
    t = (doc or "").replace("\r\n", "\n").replace("\r", "\n")
    t = _MARK.sub("", _MARK.sub("", t))
    t = _PARAM_XML.sub(" ", t)
    t = _XML.sub(" ", t)
    t = _FIELD.sub(" ", t)
    t = _BLOCK_TAG.sub(" ", t)
    t = _INLINE.sub(r" \1 ", t)
    return " ".join(t.split()).strip("*/ ")


def telling(doc: str | None, name: str | None, signature: str | None) -> str | None:
    """The description, if it tells something that name and signature don't; else None."""
    t = clean(doc)
    if not t or not any(c.isalpha() for c in t) or _EMPTY.fullmatch(t) or _LICENCE.search(t):
        return None
    parts = [p for p in re.split(r"(?<=[.;!?])\s+", t) if p]
    if all(_CODE.match(p) for p in parts):
        return None
    if sum(c.isalnum() or c.isspace() for c in t) < 0.6 * len(t):
        return None
    known = {stem(w) for w in words(name or "")} | {stem(w) for w in words(signature or "")}
    said = [w for w in words(t) if w not in GENERIC]
    new = {stem(w) for w in said if not w.isdigit() and 3 <= len(w) < 40} - known
    cjk = sum("぀" <= c <= "鿿" for c in t)
    return t if new or cjk >= 4 else None


@F.pandas_udf(T.StructType().add("description", T.StringType()).add("origin", T.StringType()))
def describe(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """(summary, documentation in code, the declaration's two, name, signature) to the first telling text and whose it is (own, declaration), or nulls."""
    for columns in it:
        out = []
        for *texts, name, signature in zip(*(c.astype(object).where(c.notna(), None) for c in columns)):
            best = (None, None)
            for k, t in enumerate(texts):
                if t and t.strip() and (said := telling(t, name, signature)):
                    best = (said, "own" if k < 2 else "declaration")
                    break
            out.append(best)
        yield pd.DataFrame(out, columns=["description", "origin"], dtype=object)


def normal_signature(sig: Column) -> Column:
    """Parameter types and names without blanks, defaults and modifiers: what tells overloads apart."""
    inner = F.regexp_extract(sig, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(inner, r"\s*=\s*[^,()]+", ""), r"\b(?:final|const|in|out|ref|readonly|self|this|mut)\b|[\s$&*?]", ""))


def lent(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(symbol_id, l_summary, l_inside): what the documented bodiless declaration of the same qualified name and signature says, for each definition that has one.

    rows: symbol_id, repo, file_id, name, key, start_byte, end_byte, summary, inside, bodiless. Name and signature meet first; the enclosing class is looked up only for
    what is left, so that the join on files stays small. Of several declarations the smallest id lends.
    """
    keys = ["repo", "name", "key"]
    says = F.length(F.trim(F.concat_ws("", "summary", "inside"))) > 0
    lenders = rows.where("bodiless and name is not null").where(says)
    takers = rows.where("not bodiless and name is not null").join(lenders.select(*keys).distinct(), keys, "left_semi")
    lenders = lenders.join(takers.select(*keys).distinct(), keys, "left_semi")

    def qualified(df: DataFrame) -> DataFrame:
        at = df.select("symbol_id", "file_id", "start_byte", "end_byte")
        j = at.join(classes, (at["file_id"] == classes["cf"]) & (F.col("start_byte") >= F.col("cs")) & (F.col("end_byte") <= F.col("ce")))
        inner = j.groupBy("symbol_id").agg(F.min(F.struct(F.col("ce") - F.col("cs"), F.col("owner"))).alias("c")).select("symbol_id", F.col("c.owner").alias("owner"))  # the innermost class
        return df.join(inner, "symbol_id", "left").withColumn("owner", F.coalesce("owner", F.lit("")))

    lend = qualified(lenders).groupBy("owner", *keys).agg(F.min(F.struct("symbol_id", "summary", "inside")).alias("l"))
    return qualified(takers).select("symbol_id", "owner", *keys).join(lend, ["owner", *keys]).select("symbol_id", F.col("l.summary").alias("l_summary"), F.col("l.inside").alias("l_inside"))


def documented(symbols: DataFrame, chunks: DataFrame, files: DataFrame, with_code: bool = True) -> DataFrame:
    """(symbol_id, name, signature, description, origin[, code]) of functions and methods whose code is not null and that have a telling description.

    origin: own, or declaration where a bodiless declaration of the same qualified name and signature, in whatever file of the repository, is the one
    that tells something. Each symbol once; repeated rows, extra columns, null names and signatures are harmless; empty tables give no row.
    """
    doc = chunks.where("symbol_id is not null and code is not null").select(
        "symbol_id", "summary", doc_in_code(F.col("code")).alias("inside"), (~F.col("code").rlike(r"[{]|:\s*(?:#[^\n]*)?\n|=>|:\s*\S+\s*$")).alias("bodiless")
    )
    own = symbols.where(F.col("kind").isin(KINDS)).select(F.col("id").alias("symbol_id"), "file_id", "name", "signature", "start_byte", "end_byte", normal_signature(F.coalesce("signature", F.lit(""))).alias("key"))
    # no code from here on: the table of names and comments is narrow and read several times
    rows, _ = materialize(own.join(doc, "symbol_id").dropDuplicates(["symbol_id"]), "documented")
    repos = files.select(F.col("id").alias("file_id"), F.coalesce("repo_id", F.lit("")).alias("repo")).distinct()
    classes = symbols.where("kind = 'class' and start_byte is not null").select(F.col("file_id").alias("cf"), F.col("name").alias("owner"), F.col("start_byte").alias("cs"), F.col("end_byte").alias("ce"))
    taken = lent(rows.join(repos, "file_id"), classes)
    told = rows.join(taken, "symbol_id", "left").select("symbol_id", "name", "signature", describe("summary", "inside", "l_summary", "l_inside", "name", "signature").alias("d"))
    pairs = told.where("d.description is not null").select("symbol_id", "name", "signature", "d.description", "d.origin")
    if not with_code:
        return pairs
    return pairs.join(chunks.where("code is not null").select("symbol_id", "code").dropDuplicates(["symbol_id"]), "symbol_id")
