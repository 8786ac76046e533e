"""Visually identical text in one form (problem 1).

Text is cut into tokens, runs of characters between blanks, digits and punctuation that take part in no conversion and
that none crosses. Each distinct token that isn't plain ASCII is converted once: exploded to positioned code points,
joined with the (broadcast) decomposition and letter tables, freed of invisible characters, its look-alike letters
replaced by those of the word's own script, combining marks ordered by class and recomposed, and the string rebuilt.
Only tokens with letters of two scripts, or with a character that looks like kana, go through the windows that find a
word's own script and a character's neighbours.

Plain form: wide, narrow, joined and presentation variants and letter-like fonts become the plain characters (super-
and subscripts, fractions and circled characters look different and stay); a letter and a separate mark become the
composed letter; characters without width vanish; every blank is U+0020. A letter of another script inside a Latin,
Greek or Cyrillic word becomes the similar-looking letter of the word's own script: of the scripts it has letters of,
the one that fewest of its letters can't be written in, then the one with most letters, then Latin, Cyrillic, Greek.
Which letters look alike is taken from the published confusables data, in the release that Spark's Unicode library
carries, before any compatibility folding; a letter is only ever replaced by one of the scripts' everyday letters, so
that a Latin word isn't taken for a Cyrillic one of rare letters. A kanji or dash that looks like kana becomes kana where
it touches katakana and no other kanji.

Null stays null, '' stays ''; texts of any length are taken whole; a repeated text gets the same form each time.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, hot_join

#: Letters that look alike, as Latin, Cyrillic, Greek ('.': none).
ALIKE = """
A А Α   B В Β   C С .   E Е Ε   H Н Η   I І Ι   J Ј .   K К Κ   M М Μ   N . Ν   O О Ο   P Р Ρ   S Ѕ .   T Т Τ   X Х Χ
Y У Υ   Z . Ζ   Q Ԛ .   W Ԝ .   a а α   c с .   d ԁ .   e е .   h һ .   i і ι   j ј .   k к κ   o о ο   p р ρ   q ԛ .
s ѕ .   u . υ   v ѵ ν   w ԝ .   x х χ   y у .   l ӏ .   V Ѵ .   . Г Γ   . П Π   . Ф Φ   . Л Λ
"""
#: Everyday letters of Latin, Cyrillic and Greek: only these are put in the place of others.
EVERYDAY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюяІіЇїЄєЈјЅѕ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρσςτυφχψω"
#: Kanji that look like katakana.
KANA_ALIKE = {"一": "ー", "二": "ニ", "三": "ミ", "八": "ハ", "力": "カ", "口": "ロ", "工": "エ", "卜": "ト", "夕": "タ", "才": "オ", "千": "チ", "厶": "ム", "乂": "メ", "丿": "ノ", "匕": "ヒ", "亻": "イ"}
#: Strokes that stand for the long-vowel mark between katakana.
STROKES = "‐‑‒–—―─━−"
#: Variants that look different from the plain characters.
DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>")
#: Default-ignorable characters that aren't of category Cf.
IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Cf characters that can be seen.
SEEN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
BLANKS = {*"\t\n\x0b\x0c\r\x85"}


def is_blank(c: str) -> bool:
    return c in BLANKS or unicodedata.category(c) in ("Zs", "Zl", "Zp")


def is_invisible(c: str) -> bool:
    return ord(c) in IGNORABLE or unicodedata.category(c) in ("Cf", "Cc") and ord(c) not in SEEN and not is_blank(c)


def _decompose(c: str) -> str:
    if is_invisible(c):
        return ""
    if is_blank(c):
        return " "
    d = unicodedata.decomposition(c)
    if not d or d.startswith(DIFFERENT):
        return c
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[1] == "0020" and len(parts) > 2:  # a spacing mark, such as U+00B4
            return c
        parts = parts[1:]
    return "".join(_decompose(chr(int(x, 16))) for x in parts)


@cache
def decompositions() -> list[tuple[str, list[str]]]:
    """Every code point that isn't its own plain form or whose class of marks isn't 0, from the rules above."""
    out = []
    for i in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        if (d := _decompose(c)) != c:
            out.append((c, list(d)))
    return out + [(c, _decompose(c) and [_decompose(c)] or []) for c in map(chr, range(0x20)) if _decompose(c) != c] + [("\x7f", [])]


@cache
def mark_classes() -> list[tuple[str, int]]:
    return [(chr(i), k) for i in range(0x300, sys.maxunicode + 1) if not 0xAC00 <= i <= 0xDFFF and (k := unicodedata.combining(chr(i)))]


@cache
def compositions() -> list[tuple[str, str]]:
    """(two code points, their composed character) of the canonical compositions, without Hangul."""
    out = []
    for i in range(0xC0, 0x30000):
        c = chr(i)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and " " in d and not 0xAC00 <= i <= 0xD7A3 and unicodedata.normalize("NFC", c) == c:
            out.append(("".join(chr(int(x, 16)) for x in d.split()), c))
    return out


def script_of(c: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter, else ''."""
    name = unicodedata.name(c, "") if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") else ""
    return next((k for k, word in (("L", "LATIN "), ("C", "CYRILLIC "), ("G", "GREEK ")) if name.startswith(word)), "")


@cache
def _pairs() -> dict[str, tuple[str, str, str]]:
    """Letter -> its Latin, Cyrillic and Greek double of the fixed list, everyday letters only."""
    flat = ALIKE.split()
    rows: dict[str, tuple[str, str, str]] = {}
    for i in range(0, len(flat), 3):
        trio = tuple(x if x in e else "" for x, e in zip(flat[i : i + 3], EVERYDAY))
        rows |= {x: trio for x in flat[i : i + 3] if x != "."}
    return rows


_LETTERS: list[tuple[str, str, str, str, str]] = []


def letters(spark: SparkSession) -> list[tuple[str, str, str, str, str]]:
    """(letter, script, its Latin, Cyrillic and Greek double): everyday letters by the fixed list, as the published data
    also pair letters that hardly look alike; rarer letters, when of one case and prototype in those data. Where several
    everyday letters share a prototype the lowest code point stands for its script."""
    if not _LETTERS:
        icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        code = [c for i in (*range(0x41, 0x530), *range(0x1C80, 0x1C90), *range(0x1D00, 0x2000), *range(0x2C60, 0x2C80), *range(0x2DE0, 0x2E00), *range(0xA640, 0xA6A0), *range(0xA720, 0xA800)) if script_of(c := chr(i))]
        # one call: prototypes are per code point, and a line end is its own
        shapes = icu.getSkeleton("\n".join(code)).split("\n")
        case = lambda c: unicodedata.category(c) == "Lu"
        best: dict[tuple[str, bool], dict[str, str]] = {}
        for c, shape in zip(code, shapes):
            k = script_of(c)
            if c in EVERYDAY["LCG".index(k)]:
                best.setdefault((shape, case(c)), {}).setdefault(k, c)
        for c, shape in zip(code, shapes):
            doubles = best.get((shape, case(c)), {})
            trio = _pairs().get(c, ()) or (tuple(doubles.get(k, "") for k in "LCG") if c not in "".join(EVERYDAY) else ())
            if any(x and x != c for x in trio):
                _LETTERS.append((c, script_of(c), *trio))
    return _LETTERS


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Decompositions and properties of code points: of bounded size, as Unicode is."""
    classes, doubles = dict(mark_classes()), {c: r for c, *r in letters(spark)}
    return (
        spark.createDataFrame([(c, p, c in doubles) for c, p in decompositions()], "ch string, parts array<string>, late boolean"),
        spark.createDataFrame([(c, classes.get(c, 0), *doubles.get(c, (None,) * 4)) for c in classes | doubles], "c string, cls int, alike string, lat string, cyr string, gre string"),
    )


def token_key(token: Column) -> Column:
    return F.unhex(F.md5(token))


def _recompose(chars: Column) -> Column:
    """A starter and its marks, in order, to the composed string: a fold over the few code points of one segment."""
    # one constant, not two thousand expressions
    pairs = F.str_to_map(F.lit("\n".join("\t".join(kv) for kv in compositions())), F.lit("\n"), F.lit("\t"))
    code = lambda s: F.ascii(s)  # noqa: E731  (ascii gives the code point of the first character)

    def step(acc: Column, x: Column) -> Column:
        free = (acc["rest"] == "") | (acc["last"] < x["cls"])
        one = F.when(free & (acc["head"] != ""), F.element_at(pairs, F.concat(acc["head"], x["ch"])))
        return F.when(one.isNotNull(), F.struct(one.alias("head"), acc["rest"].alias("rest"), acc["last"].alias("last"))).when(
            acc["head"] == "", F.struct(F.when(x["cls"] == 0, x["ch"]).otherwise(F.lit("")).alias("head"), F.when(x["cls"] == 0, acc["rest"]).otherwise(F.concat(acc["rest"], x["ch"])).alias("rest"), x["cls"].alias("last"))
        ).otherwise(F.struct(acc["head"].alias("head"), F.concat(acc["rest"], x["ch"]).alias("rest"), x["cls"].alias("last")))

    start = F.struct(F.lit("").alias("head"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    folded = F.aggregate(chars, start, step, lambda a: F.concat(a["head"], a["rest"]))
    return F.when(F.size(chars) == 1, chars[0]["ch"]).otherwise(folded)


#: Characters outside the scripts' own that can decompose to letters, or to what looks like kana.
MAYBE_LETTERS = r"[℀-⅏㌀-㏿\x{1D400}-\x{1D7FF}]"
MAYBE_KANA = r"⼀-⿟豈-﫿︰-﹏"


def _own_letters(d: DataFrame) -> DataFrame:
    """d (key, pos, sub, c, cls, script, kind, lat, cyr, gre) with c replaced where it stands for a letter of the word's
    own script or for kana."""
    order = Window.partitionBy("key").orderBy("pos", "sub")
    mark = F.col("cls") > 0
    d = d.withColumn("word", F.sum(F.when(F.col("script").isNull() & ~mark, 1).otherwise(0)).over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, as what precedes in the reverse order: a frame that grows costs each row once
    after = Window.partitionBy("key").orderBy(F.desc("pos"), F.desc("sub")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("kind") != "A", F.col("kind"))
    d = d.withColumns({"left": F.last(known, ignorenulls=True).over(before), "near": F.last("kind", ignorenulls=True).over(before), "right": F.last(known, ignorenulls=True).over(after)})
    in_word = Window.partitionBy("key", "word")
    # a letter bars every script it neither belongs to nor has a double in
    double = {"L": "lat", "C": "cyr", "G": "gre"}
    score = {}
    for k, c in double.items():
        mine = F.col("script") == k
        bars = F.col("script").isNotNull() & ~mine & (F.coalesce(F.col(c), F.lit("")) == "")
        score[k] = F.when(F.sum(F.when(mine, 1).otherwise(0)).over(in_word) > 0, F.sum(F.when(mine, 1).when(bars, -1_000_000).otherwise(0).cast("long")).over(in_word)).otherwise(F.lit(-(1 << 60)))
    d = d.withColumns({"sl": score["L"], "sc": score["C"], "sg": score["G"]})
    most = F.greatest("sl", "sc", "sg")
    own = F.when(F.col("sl") == most, "L").when(F.col("sc") == most, "C").otherwise("G")
    to = F.when(own == "L", F.col("lat")).when(own == "C", F.col("cyr")).otherwise(F.col("gre"))
    letter = F.when((F.col("script") != own) & (to != ""), to)
    kana = F.create_map(*[F.lit(x) for kv in KANA_ALIKE.items() for x in kv])
    touches = ((F.col("left") == "K") | (F.col("right") == "K")) & ~F.coalesce(F.col("left") == "H", F.lit(False)) & ~F.coalesce(F.col("right") == "H", F.lit(False))
    stroke = F.when((F.col("left") == "K") & (F.col("right") == "K"), F.lit("ー"))
    as_kana = F.when(F.col("kind") == "A", F.when(F.col("c").isin(*STROKES), stroke).when(F.col("c") == "一", F.when(touches & F.coalesce(F.col("near").isin("K", "A"), F.lit(False)), F.lit("ー"))).otherwise(F.when(touches, F.element_at(kana, F.col("c")))))
    return d.withColumn("c", F.coalesce(letter, as_kana, F.col("c")))


def plain_tokens(tokens: DataFrame) -> DataFrame:
    """(key, token, plain) of distinct tokens (column token, not null). Tokens may be of any length."""
    spark = tokens.sparkSession
    parts, props = _tables(spark)
    # written down: they are exploded and met again, and the texts needn't be cut twice for that
    base = checkpoint(tokens.select(token_key(F.col("token")).alias("key"), "token").dropDuplicates(["key"]))
    token = F.col("token")
    # letters of two scripts, or something like kana beside katakana: the rest has no letter to replace
    scripts = sum((F.when(token.rlike(rf"\p{{Is{s}}}"), 1).otherwise(0) for s in ("Latin", "Cyrillic", "Greek")), F.when(token.rlike(MAYBE_LETTERS), 1).otherwise(0))
    like_kana = token.rlike("[" + "".join(KANA_ALIKE) + STROKES + MAYBE_KANA + "]") & token.rlike(r"[\p{IsKatakana}ーｰ]")
    # told once per token: beside the explosion it would be told anew for each of the token's code points
    marked = base.select("key", "token", ((scripts > 1) | like_kana).alias("odd"))
    points = marked.select("key", "odd", F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    # letters that look like others are held against them before they take their compatibility form
    kept = F.col("parts").isNull() | (F.col("odd") & F.col("late"))
    d = points.join(F.broadcast(parts), "ch", "left").select("key", "odd", "pos", F.posexplode_outer(F.when(kept, F.array("ch")).otherwise(F.col("parts"))).alias("sub", "c")).where("c is not null")
    d = d.join(F.broadcast(props), "c", "left").withColumn("cls", F.coalesce("cls", F.lit(0)))
    mark = F.col("cls") > 0
    c = F.col("c")
    script = F.when(mark, None).when(F.col("alike").isNotNull(), F.col("alike")).when(c.rlike(r"\p{IsLatin}"), "L").when(c.rlike(r"\p{IsCyrillic}"), "C").when(c.rlike(r"\p{IsGreek}"), "G")
    kind = F.when(mark, None).when(c.isin(*KANA_ALIKE, *STROKES), "A").when(c.rlike(r"\p{IsKatakana}|ー"), "K").when(c.rlike(r"\p{IsHan}"), "H").otherwise("o")
    odd = _own_letters(d.where("odd").withColumns({"script": script, "kind": kind})).select("key", "pos", "sub", "c")
    late = F.broadcast(parts.where("late").select(F.col("ch").alias("c"), "parts"))
    odd = odd.join(late, "c", "left").select("key", "pos", "sub", F.posexplode(F.coalesce("parts", F.array("c"))).alias("n", "c"))
    odd = odd.join(F.broadcast(props.select("c", "cls")), "c", "left").select("key", "pos", (F.col("sub") * 32 + F.col("n")).alias("sub"), "c", F.coalesce("cls", F.lit(0)).alias("cls"))
    d = d.where("not odd").select("key", "pos", "sub", "c", "cls").unionByName(odd)
    mark = F.col("cls") > 0
    jamo = F.col("c").between("ᅡ", "ᅵ") | F.col("c").between("ᆨ", "ᇂ")
    d = d.withColumn("seg", F.sum(F.when(mark | jamo, 0).otherwise(1)).over(Window.partitionBy("key").orderBy("pos", "sub")))
    segments = d.groupBy("key", "seg").agg(F.sort_array(F.collect_list(F.struct("cls", "pos", "sub", F.col("c").alias("ch")))).alias("x"))
    strings = segments.select("key", "seg", F.when(F.size("x") == 1, F.col("x")[0]["ch"]).otherwise(_recompose(_hangul("x"))).alias("s"))
    plain = strings.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "s"))), lambda x: x["s"]), "").alias("plain"))
    return base.join(plain, "key", "left").select("key", "token", F.coalesce("plain", F.lit("")).alias("plain"))


def _hangul(chars: str) -> Column:
    """Conjoining jamo at the head of a segment as one syllable, by the arithmetic of the standard."""
    x = F.col(chars)
    cp = lambda i: F.ascii(F.get(x, F.lit(i))["ch"])
    lead, vowel, tail = cp(0), cp(1), cp(2)
    is_l, is_v = lead.between(0x1100, 0x1112), vowel.between(0x1161, 0x1175)
    is_lv = lead.between(0xAC00, 0xD7A3) & (F.pmod(lead - 0xAC00, F.lit(28)) == 0)
    one = lambda code, skip: F.concat(F.array(F.struct(F.lit(0).alias("cls"), x[0]["pos"].alias("pos"), x[0]["sub"].alias("sub"), F.decode(F.unhex(F.hex(code)), "UTF-16BE").alias("ch"))), F.slice(x, skip + 1, F.greatest(F.size(x) - skip, F.lit(0))))
    lv = F.lit(0xAC00) + (lead - 0x1100) * 588 + (vowel - 0x1161) * 28
    made = F.when(is_l & is_v & tail.between(0x11A8, 0x11C2), one(lv + tail - 0x11A7, 3)).when(is_l & is_v, one(lv, 2)).when(is_lv & vowel.between(0x11A8, 0x11C2), one(lead + vowel - 0x11A7, 2))
    return F.when((F.size(x) > 1) & lead.between(0x1100, 0xD7A3), F.coalesce(made, x)).otherwise(x)


#: Characters between tokens: plain by themselves, composing with nothing, and of no script.
BETWEEN = r" -;?@\[-`{-~、。「」『』【】〈〉《》・"


def _cut(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[^{BETWEEN}]+"), F.lit(0))).alias("token")).where(F.col("token").rlike("[^ -~]"))


def changed_tokens(df: DataFrame, text: str) -> DataFrame:
    """(key, token, plain) of the distinct tokens of column text whose plain form differs."""
    return plain_tokens(_cut(df.select(text), text).select("token").distinct()).where("plain <> token")


#: Changed tokens that may be broadcast; with more, the rows are shuffled to meet them, frequent tokens in pieces.
BROADCAST_TOKENS = 500_000


def _meet(rows: DataFrame, bad: DataFrame, how: str) -> DataFrame:
    bad = checkpoint(bad)
    return rows.join(F.broadcast(bad), "key", how) if bad.count() <= BROADCAST_TOKENS else hot_join(rows, bad, ["key"], how)


def not_plain(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Distinct keys of the rows whose text isn't in plain form."""
    rows = _cut(df.select(*keys, text), text).select(*keys, token_key(F.col("token")).alias("key"))
    return _meet(rows, changed_tokens(df, text).select("key"), "left_semi").select(*keys).distinct()


def plain_texts(df: DataFrame, text: str, row: str, out: str = "plain") -> DataFrame:
    """df with its text in plain form in column out; row: a column that is unique. Only rows with a token that changes
    are taken apart and rebuilt."""
    bad = changed_tokens(df, text).select("key", F.col("plain").alias("_plain"))
    # tokens and what is between them, in turn
    pieces = lambda c: F.regexp_extract_all(c, F.lit(f"[^{BETWEEN}]+|[{BETWEEN}]+"), F.lit(0))
    cut = df.where(F.col(text).rlike("[^ -~]")).select(F.col(row).alias("_row"), F.posexplode(pieces(F.col(text))).alias("_at", "token"))
    cut = cut.where(F.col("token").rlike("[^ -~、。「」『』【】〈〉《》・]")).select("_row", "_at", token_key(F.col("token")).alias("key"))
    hit = _meet(cut, bad, "inner").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_plain"))).alias("_new"))
    joined = df.join(hit, F.col(row) == F.col("_row"), "left")
    rebuilt = F.array_join(F.transform(pieces(F.col(text)), lambda x, i: F.coalesce(F.element_at("_new", i), x)), "")
    return joined.withColumn(out, F.when(F.col("_new").isNull(), F.col(text)).otherwise(rebuilt)).drop("_row", "_new")
