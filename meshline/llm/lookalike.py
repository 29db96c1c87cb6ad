"""Visually identical text with different characters: look-alike mapping and collation classes in SQL, canonical members."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meshline.session import cut

COLLATION = "UNICODE_CI"
# Cyrillic, Greek and Latin letters, and the letters of the same shape they are brought to.
CYRILLIC_UPPER = ("АВЕЅІЈКМНОРСТУХԌԚԜѴӀҮ", "ABESIJKMHOPCTYXGQWVIY")
CYRILLIC_LOWER = ("аеѕіјкорсухһԁԛԝѵӏү", "aesijkopcyxhdqwvly")
GREEK_UPPER = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ")
GREEK_LOWER = ("αικνορυχγϲϳ", "aikvopuxycj")
CYRILLIC_AS_GREEK = ("ГПФф", "ΓΠΦφ")
LATIN_LOWER = ("ɑɡ", "ag")
# Characters without a width of their own besides the format characters (category Cf).
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
LINE_ENDS = "\n\r\x85\u2028\u2029"


_SHAPES = {ord(a): b for one, other in (CYRILLIC_UPPER, CYRILLIC_LOWER, GREEK_UPPER, GREEK_LOWER, CYRILLIC_AS_GREEK, LATIN_LOWER) for a, b in zip(one, other, strict=True)}


class _Table(dict):
    """What each character is brought to, filled on its first use: nothing, a plain space, a look-alike or itself."""

    def __missing__(self, code: int):
        ch = chr(code)
        cat = unicodedata.category(ch)
        if cat == "Cf" or ch in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            to: object = None
        elif ch not in LINE_ENDS and (cat == "Zs" or ch in "\t\v\f"):
            to = " "
        else:
            to = _SHAPES.get(code, code)
        self[code] = to
        return to


_CLEAN = _Table()


def one_form(text: str | None) -> str | None:
    """The one form of a text; null stays null.

    Invisible characters go, every kind of space but a line end becomes one
    plain space, width and compatibility forms are resolved, look-alike letters
    of Latin, Cyrillic and Greek become one letter with their accents kept, and
    accents are composed. Case, accents, punctuation, digits and the number of
    spaces stay.
    """
    if text is None:
        return None
    if text.isascii():
        return text.translate(_CLEAN) if "\t" in text or "\v" in text or "\f" in text else text
    flat = unicodedata.normalize("NFKD", text.translate(_CLEAN)).translate(_CLEAN)
    return unicodedata.normalize("NFC", flat)


@lru_cache(maxsize=1)
def _mapping() -> tuple[str, str, str]:
    """The characters that ``translate`` maps, what it maps them to, and those that it leaves to ``one_form``.

    By rule, over all characters: letters with a look-alike (accented and
    compatibility forms included) and kinds of space go to the one character of
    their form; invisible characters, which stand beyond the second string's
    end, are deleted. Left are look-alikes whose form is several characters, and
    characters of the decompositions that the collation does not follow.
    """
    change, gone, left = [], [], []
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if _CLEAN[code] is None:
            gone.append(ch)
        elif _CLEAN[code] == " " or code in _SHAPES or any(ord(x) in _SHAPES for x in unicodedata.normalize("NFKD", ch)):
            to = one_form(ch)
            if len(to) > 1:
                left.append(ch)
            elif to != ch:
                change.append((ch, to))
        elif unicodedata.decomposition(ch).startswith(("<compat>", "<super>", "<sub>", "<vertical>")) and not unicodedata.normalize("NFKD", ch).isascii() or unicodedata.normalize("NFKD", ch)[0] == " " or one_form(ch) == "s":
            left.append(ch)
    known = {f"{ord(c):04X}" for c in left}
    left += [chr(c) for c in range(128, sys.maxunicode + 1) if known & set(unicodedata.decomposition(chr(c)).split())]
    change += [(c, " ") for c in "\t\v\f"]
    return "".join(a for a, _ in change) + "".join(gone), "".join(b for _, b in change), "".join(left)


def mapped(text: Column) -> Column:
    """``text`` with look-alike letters and kinds of space as one character each, and without invisible characters."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.translate(text, "\t\v\f", "   ")).otherwise(F.translate(text, *_mapping()[:2]))


def with_form(docs: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """``docs`` with the column ``form``; the other columns pass through untouched."""
    if form in docs.columns:
        raise ValueError(f"the table already has a column {form!r}; name another one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            made = pa.array([one_form(t) for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, form])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(form, StringType())]))


def shapes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, shape): each text that is not blank, with its look-alike-mapped value, made in SQL.

    The collation neither orders stacked accents nor follows a few kinds of
    decomposition; texts with a mark after a letter beyond ASCII, or with such a
    character, are brought to their whole form first.
    """
    told = docs.where("doc_id is not null and text is not null").select("doc_id", "text").withColumn("shape", mapped(F.col("text")))
    # the cheap test first: most texts are ASCII
    plain = (F.octet_length("shape") == F.length("shape")) | ~F.col("shape").rlike(r"[^\x00-\x7F]\p{M}") & (F.translate("shape", _mapping()[2], "") == F.col("shape"))
    composed = with_form(told.where(~plain).select("doc_id", "text"), "text", "shape")
    return told.where(plain).unionByName(composed).where("trim(BOTH ' \n\r\t' FROM shape) <> ''")


def _keyed(told: DataFrame) -> DataFrame:
    """(doc_id, text_id, class_key): the collation's own key of each shape, as a hash of it.

    Hash functions follow a collation only under a session setting, which holds
    while the keys are made; where a session does not know it, the shape itself
    is the key, under its collation.
    """
    conf, name = told.sparkSession.conf, "spark.sql.legacy.collationAwareHashFunctions"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        collated = F.collate("shape", COLLATION)
        aware = told.sparkSession.sql(f"SELECT xxhash64(collate('A', '{COLLATION}')) = xxhash64(collate('a', '{COLLATION}'))").first()[0]
        return cut(told.select("doc_id", F.xxhash64("text").alias("text_id"), (F.xxhash64(collated) if aware else collated).alias("class_key")))
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, class_key): the documents of collation classes that hold two different texts or more.

    Mapped values are grouped under the accent-sensitive Unicode collation, which
    passes over width, compatibility forms, composition and letter case. Only
    keys are shuffled, and copies of a text fold on the map side; the texts of
    the classes found are joined back.
    """
    keyed = _keyed(shapes(docs))
    several = keyed.groupBy("class_key").agg(F.min("text_id").alias("one"), F.max("text_id").alias("other")).where("one <> other").select("class_key")
    members = keyed.join(several, "class_key").select("doc_id", "class_key").distinct()
    return docs.select("doc_id", "text").join(members, "doc_id").where("text is not null")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, form_id, canonical_id) of the documents whose text agrees in form with a different text.

    The collation class decides who is compared; as it equates more than the
    form does (case, control characters), its members are then told apart by
    the exact form. The lowest document of a class and form is canonical.
    """
    exact = with_form(candidates(docs)).where("trim(BOTH ' \n\r\t' FROM form) <> ''")
    members = cut(exact.select("doc_id", F.sha2("text", 256).alias("text_id"), "class_key", F.sha2("form", 256).alias("form_id")).distinct())
    named = members.groupBy("class_key", "form_id").agg(F.min("doc_id").alias("canonical_id"), F.min("text_id").alias("one"), F.max("text_id").alias("other")).where("one <> other")
    return members.join(named.drop("one", "other"), ["class_key", "form_id"]).select("doc_id", "text_id", "form_id", "canonical_id")


def agreeing_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose stored texts differ and whose forms are equal.

    Blank, empty and null texts form no pair; repeated rows count once.
    """
    found = cut(classes(docs))
    one, other = found.alias("a"), found.alias("b")
    same = (F.col("a.canonical_id") == F.col("b.canonical_id")) & (F.col("a.form_id") == F.col("b.form_id"))
    pairs = one.join(other, same & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.text_id") != F.col("b.text_id")))
    return pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")).distinct()


def canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, form, canonical_id): every document in its one form, with its class's lowest document or itself."""
    told = with_form(docs.select("doc_id", "text").withColumn("text_id", F.sha2("text", 256)))
    named = classes(docs).groupBy("text_id").agg(F.min("canonical_id").alias("canonical_id"))
    return told.join(named, "text_id", "left").select("doc_id", "form", F.coalesce("canonical_id", "doc_id").alias("canonical_id"))
