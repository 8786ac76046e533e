"""Column functions over labels, titles and captured text (F7-F34, N1, N3, P20 of the inventory).

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column) -> Column:
    """Outer white space of any kind, as Unicode defines it, taken off."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_ascii(c: Column) -> Column:
    """A-Z made lower case, nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def like_ascii(c: Column, keyword: str, literal: bool = False) -> Column:
    """Substring search that ignores the case of ASCII letters only; % and _ of the keyword are wildcards unless literal."""
    folded = keyword.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    if literal:
        return fold_ascii(c).contains(folded)
    return fold_ascii(c).like("%" + folded.replace("\\", "\\\\") + "%")


def without_digits(c: Column) -> Column:
    """Decimal digits of every script taken out."""
    return F.regexp_replace(c, r"\p{Nd}+", "")


def fingerprint_of_lines(lines: Column) -> Column:
    """First 16 hex digits of the MD5 of the sorted, digit-free, stripped lines of two characters or more (F1, text part)."""
    kept = F.filter(F.transform(lines, lambda x: strip(without_digits(x))), lambda x: F.length(x) > 1)
    return F.substring(F.md5(F.array_join(F.array_sort(kept), "|")), 1, 16)


def _height(boxes: Column) -> Column:
    """Screen height guessed from the lowest box."""
    ys = F.flatten(F.transform(boxes, lambda r: F.transform(r["box"], lambda p: p[1])))
    return F.coalesce((F.array_max(ys) * F.lit(1.05)).cast("int"), F.lit(2000))


def _width(boxes: Column) -> Column:
    xs = F.flatten(F.transform(boxes, lambda r: F.transform(r["box"], lambda p: p[0])))
    return F.coalesce((F.array_max(xs) * F.lit(1.05)).cast("int"), F.lit(1000))


def with_size(boxes: Column, f) -> Column:
    """f(boxes, height, width), with the screen's size computed once per row and not once per box."""
    sized = F.transform(F.array(F.struct(boxes.alias("b"), _height(boxes).alias("h"), _width(boxes).alias("w"))), lambda s: f(s["b"], s["h"], s["w"]))
    return F.get(sized, F.lit(0))


def fingerprint_v2(boxes: Column) -> Column:
    """Fingerprint of recognised text without digits and status bar (F1). boxes: array of struct(text, confidence, box, center)."""
    kept = with_size(boxes, lambda b, h, w: F.filter(b, lambda r: (r["confidence"] >= 0.75) & (r["center"][1] >= h * F.lit(0.05))))
    return fingerprint_of_lines(F.transform(kept, lambda r: r["text"]))


def fingerprint_v1(boxes: Column) -> Column:
    """Fingerprint with digits, status bar of 100 pixels (F2)."""
    kept = F.filter(boxes, lambda r: (r["confidence"] >= 0.75) & (r["center"][1] >= 100) & (F.length(r["text"]) > 1))
    return F.substring(F.md5(F.array_join(F.array_sort(F.transform(kept, lambda r: r["text"])), "|")), 1, 16)


#: Texts that are no titles.
NO_TITLES = [">", "›", "<", "‹", "7", "L", "戻る", "Done", "完了", "Edit", "編集", "キャンセル"]


def box_height(box: Column) -> Column:
    """Height of a box of four points."""
    ys = F.transform(box, lambda p: p[1])
    return F.array_max(ys) - F.array_min(ys)


def screen_title(boxes: Column) -> Column:
    """Title of a screen: the tallest text near the top, else the surest centred text, else 'unknown' (F4). First on ties."""
    return with_size(boxes, _title)


def _title(boxes: Column, h: Column, w: Column) -> Column:
    # cheap conditions go first, so that few texts are stripped
    sure = F.filter(F.transform(boxes, lambda r, i: F.struct(r["text"].alias("text"), r["confidence"].alias("conf"), r["center"].alias("c"), r["box"].alias("box"), (-i).alias("order"))), lambda r: (r["conf"] > 0.8) & (r["c"][1] > h * F.lit(0.05)) & (r["c"][1] < h * F.lit(0.30)))
    named = F.filter(sure, lambda r: F.length(r["text"]).between(2, 20) & ~strip(r["text"]).isin(NO_TITLES))
    base = F.transform(named, lambda r: F.struct(r["text"].alias("text"), r["conf"].alias("conf"), r["c"].alias("c"), box_height(r["box"]).alias("tall"), r["order"].alias("order")))
    large = F.filter(base, lambda r: (r["c"][1] < h * F.lit(0.30)) & (r["tall"] >= h * F.lit(0.03)))
    nav = F.filter(base, lambda r: (r["c"][1] < h * F.lit(0.20)) & (r["c"][0] >= w * F.lit(0.20)) & (r["c"][0] <= w * F.lit(0.80)))
    first = lambda rows, key: F.array_max(F.transform(rows, lambda r: F.struct(r[key], r["order"], r["text"].alias("text"))))["text"]
    return F.coalesce(first(large, "tall"), first(nav, "conf"), F.lit("unknown"))


#: Texts never tapped, words of actions, single characters that stand for icons.
NEVER_TAPPED = [">", "›", "<", "‹", "…", "Q", "戻る", "Back"]
ACTION_WORDS = ["OK", "完了", "次へ", "保存", "閉じる", "削除", "確認", "開く", "リセット", "転送", "続ける", "許可", "追加", "選択", "設定する", "キャンセル", "取り消し", "送信", "適用", "Done", "Save", "Next", "Close", "Delete", "Apply", "Confirm", "Cancel", "Submit", "Continue", "Allow"]
ICONS = ["⚙", "⚙️", "☰", "＋", "+", "⋮", "✕", "×"]


def contains_any(c: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(k) for k in keywords), F.lit(False))


def tappable_items(boxes: Column, least_confidence: float = 0.5) -> Column:
    """Items worth tapping, in reading order, the first of equal stripped texts (F5): array of struct(text, path), where
    path says why: action word, footer, chevron row or content."""
    return with_size(boxes, lambda b, h, w: _tappable(b, h, w, least_confidence))


def _tappable(boxes: Column, h: Column, w: Column, least_confidence: float) -> Column:
    # stripped text and height once per box
    at = F.transform(boxes, lambda r: F.struct(strip(r["text"]).alias("text"), r["confidence"].alias("conf"), r["center"][0].alias("x"), r["center"][1].alias("y"), box_height(r["box"]).alias("tall")))
    return F.get(F.transform(F.array(F.struct(at.alias("at"), h.alias("h"), w.alias("w"))), lambda s: _chosen(s["at"], s["h"], s["w"], least_confidence)), F.lit(0))


def _chosen(at: Column, h: Column, w: Column, least_confidence: float) -> Column:
    right, band = w * F.lit(0.85), h * F.lit(0.04)
    chevrons = F.filter(at, lambda r: r["text"].isin(">", "›") & (r["x"] > right))

    def path(r: Column) -> Column:
        text, x, y = r["text"], r["x"], r["y"]
        small = r["tall"] < h * F.lit(0.03)
        out = (r["conf"] < least_confidence) | (text == "") | (y < h * F.lit(0.05)) | (x > right) | ((F.length(text) <= 1) & ~text.isin(ICONS)) | text.isin(NEVER_TAPPED)
        in_row = F.exists(chevrons, lambda c: F.abs(y - c["y"]) <= band)
        content = (F.size(chevrons) < 5) & y.between(h * F.lit(0.15), h * F.lit(0.80)) & (x < w * F.lit(0.80)) & F.length(text).between(2, 20) & small & ~((x > w * F.lit(0.40)) & (F.length(text) > 12))
        return F.when(out, None).when(contains_any(text, ACTION_WORDS), "action").when(y > h * F.lit(0.80), "footer").when(in_row, F.when(small, "row")).when(content, "content")

    paths = F.filter(F.transform(at, lambda r: F.struct(r["text"].alias("text"), path(r).alias("path"))), lambda r: r["path"].isNotNull())
    return F.get(F.transform(F.array(paths), lambda p: F.filter(p, lambda r, i: F.array_position(F.transform(p, lambda x: x["text"]), r["text"]) == i + 1)), F.lit(0))


def element_type(label: Column) -> Column:
    """Icon or menu."""
    return F.when(label.startswith("icon:"), "icon").otherwise("menu")


def slug(c: Column) -> Column:
    """File-name form of a title: unsafe characters as _, 30 characters, no outer _, 'unknown' if nothing is left."""
    cut = F.substring(F.regexp_replace(c, r'(?U)[\\/:*?"<>|\s]', "_"), 1, 30)
    return F.coalesce(F.nullif(F.trim(cut, F.lit("_")), F.lit("")), F.lit("unknown"))


def safe_name(c: Column) -> Column:
    """Letters, digits, _ and - only, 10 characters, else 'item' (F11)."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""), 1, 10), F.lit("")), F.lit("item"))


def session_dir(ts: Column) -> Column:
    """yyyyMMdd_HHmmss of a start."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def duration_minutes(seconds: Column) -> Column:
    """Minutes, halves up."""
    return F.floor(seconds / 60 + F.lit(0.5)).cast("long")


def udid(c: Column) -> Column:
    """24 hex digits as 8-16 in upper case; what has a dash stays, upper-cased."""
    upper = F.upper(F.trim(c))
    return F.when(~upper.contains("-") & upper.rlike("^[0-9A-F]{24}$"), F.concat(F.substring(upper, 1, 8), F.lit("-"), F.substring(upper, 9, 16))).otherwise(upper)


def online_device(listing: Column) -> Column:
    """Serial of the first line of a device listing whose state is 'device' (F16)."""
    rows = F.transform(F.split(listing, "\n"), lambda x: F.split(x, "\t"))
    return F.get(F.get(F.filter(rows, lambda x: (F.size(x) >= 2) & (strip(F.get(x, F.lit(1))) == "device")), F.lit(0)), F.lit(0))


def os_version(runtime: Column) -> Column:
    """'...iOS-17-2' -> '17.2' (F19); null without that part."""
    return F.replace(F.nullif(F.regexp_extract(runtime, r"iOS-([0-9-]+)$", 1), F.lit("")), F.lit("-"), F.lit("."))


def version_key(version: Column) -> Column:
    """A dotted version as an array of numbers that sorts by value."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def html_escape(c: Column) -> Column:
    """& < > " ' escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sanitised(c: Column) -> Column:
    """Tags and outer blanks taken off (P20)."""
    return F.trim(F.regexp_replace(c, "<[^>]*>", ""))


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor '' (F27)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def item_label(n: Column) -> Column:
    """'1 item', '2 items' (F33)."""
    return F.concat(n.cast("string"), F.when(n == 1, " item").otherwise(" items"))


def shortened(c: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def action(c: Column) -> Column:
    """A typed command as array of one action, an empty array for skip, null if it isn't understood."""
    t = F.lower(strip(c))
    number = r"(-?\d+)"
    gap = r"[,\s]+"
    swipe = rf"^(?:swipe\s+)?{number}{gap}{number}{gap}{number}{gap}{number}(?:{gap}(\d+))?$"
    tap = rf"^(?:tap\s+)?{number}{gap}{number}(?:{gap}(\d+))?$"
    wait = r"^wait\s+([\d.]+)$"
    part = lambda rx, i: F.regexp_extract(t, rx, i).try_cast("int")
    fields = ("type", "x", "y", "wait_ms", "x1", "y1", "x2", "y2", "duration")
    kinds = {f: "string" if f == "type" else "double" if f == "duration" else "int" for f in fields}

    def one(**known: Column) -> Column:
        return F.array(F.struct(*[known.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in fields]))

    return (
        F.when(t.isin("skip", "s"), F.filter(one(type=F.lit("skip")), lambda _: F.lit(False)))
        .when(t.isin("back", "b"), one(type=F.lit("back")))
        .when(t.rlike(wait), one(type=F.lit("wait"), duration=F.regexp_extract(t, wait, 1).try_cast("double")))
        .when(t.rlike(swipe), one(type=F.lit("swipe"), x1=part(swipe, 1), y1=part(swipe, 2), x2=part(swipe, 3), y2=part(swipe, 4), duration=F.coalesce(part(swipe, 5), F.lit(300))))
        .when(t.rlike(tap), one(type=F.lit("tap"), x=part(tap, 1), y=part(tap, 2), wait_ms=part(tap, 3)))
    )


def usb_serial(c: Column) -> Column:
    """The 24 hex digits of a device listing's serial line; null without one."""
    return F.nullif(F.regexp_extract(c, r'"USB Serial Number"\s*=\s*"([0-9A-Fa-f]{24})"', 1), F.lit(""))


def is_udid(c: Column) -> Column:
    """Whether a text is a device id: 8-16 or 24 to 40 hex digits."""
    return c.rlike(r"^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{16}|[0-9A-Fa-f]{24,40})$")


def platform_of(ios: list[Column], android: list[Column]) -> Column:
    """Platform by the first kind of probe that found something, else 'unknown' (F17)."""
    some = lambda cs: reduce(lambda a, b: a | b, (F.coalesce(c, F.lit("")) != "" for c in cs))
    return F.when(some(ios), "ios").when(some(android), "android").otherwise("unknown")


def device_mode(mode: Column, android_id: Column) -> Column:
    """Mode of a device: a named mirror or Android, else Android if there is an Android id, else simulator."""
    named = F.upper(F.coalesce(mode, F.lit("")))
    return F.when(named.isin("MIRROR", "ANDROID"), named).when(F.trim(F.coalesce(android_id, F.lit(""))) != "", "ANDROID").otherwise("SIMULATOR")


def tap_evidence(x: Column, y: Column, boxes: Column) -> Column:
    """JSON of a successful tap, with the boxes if there are any."""
    return F.to_json(F.struct(F.lit("coordinate_tap").alias("action"), x.alias("x"), y.alias("y"), F.lit("success").alias("result"), boxes.alias("ocr_boxes")))


def shown_title(title: Column) -> Column:
    """Title as trees show it (F32)."""
    return F.when(title == "unknown", "❓ unknown").otherwise(F.coalesce(title, F.lit("")))


def title_warning(title: Column, n_items: Column, depth: Column) -> Column:
    """What a tree says behind a title; '' for nothing (F32)."""
    return F.when(title == "unknown", "← 要調査").when((n_items <= 1) & (depth > 0), "⚠ タップ候補少").otherwise("")


def model_key(name: Column, version: Column) -> Column:
    """struct that sorts device models: stable version (below 20) first, then version, then the plain model."""
    v = version_key(version)
    return F.struct((F.coalesce(F.get(v, F.lit(0)), F.lit(0)) < 20).alias("stable"), v.alias("version"), (name == "iPhone 16").alias("plain"))


ANALYSIS = "screen_type string, buttons array<struct<name:string,position:string,priority:int,description:string>>, confidence double"


def analysis(response: Column) -> Column:
    """A model's answer, with or without code fences, as struct with defaults; buttons without name are left out."""
    clean = F.rtrim(strip(F.regexp_replace(response, r"```(?:json)?\s*", "")), F.lit("`"))
    got = F.from_json(clean, ANALYSIS)
    bad = F.get_json_object(clean, "$").isNull()
    buttons = F.transform(F.filter(F.coalesce(got["buttons"], F.expr("cast(array() as array<struct<name:string,position:string,priority:int,description:string>>)")), lambda b: F.coalesce(b["name"], F.lit("")) != ""), lambda b: F.struct(b["name"].alias("name"), F.coalesce(b["position"], F.lit("")).alias("position"), F.coalesce(b["priority"], F.lit(2)).alias("priority"), F.coalesce(b["description"], F.lit("")).alias("description")))
    return F.struct(F.coalesce(got["screen_type"], F.lit("不明")).alias("screen_type"), buttons.alias("buttons"), F.when(bad, F.lit(None)).otherwise(F.coalesce(got["confidence"], F.lit(1.0))).alias("confidence"), bad.alias("failed"))
