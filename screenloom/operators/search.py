"""Search, coverage, lists, panels and details over screens and sessions (A1-A7, A16, J1-J9, O1-O8, P1-P11, P19 of the inventory)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like_ascii, session_dir

#: Most rows that a search returns, and that a list of a project returns.
SEARCH_LIMIT, LIST_LIMIT = 100, 500


def clamp(n: int, most: int) -> int:
    """A limit within bounds; negative ones are refused."""
    if n < 0:
        raise ValueError("a limit can't be negative")
    return min(n, most)


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; none: true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def with_sessions(screens: DataFrame, sessions: DataFrame) -> DataFrame:
    """Screens with title and mode of their session, or the defaults (J3, P11). sessions: unique session_id."""
    s = sessions.select("session_id", "game_title", "device_mode")
    return screens.join(s, "session_id", "left").withColumns({"game_title": F.coalesce("game_title", F.lit("Unknown Game")), "device_mode": F.coalesce("device_mode", F.lit("SIMULATOR"))})


def first_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session_id, the first delivered (M4)."""
    cols = [c for c in sessions.columns if c not in ("id", "session_id")]
    return sessions.where("session_id is not null").groupBy("session_id").agg(F.min(F.struct("id", *cols)).alias("r")).select("session_id", "r.id", *[f"r.{c}" for c in cols])


def matching(title: str | None = None, keyword: str | None = None, session_id: str | None = None, game: str | None = None, literal: bool = False) -> Column:
    """Condition of a search; filters that are None or '' don't count."""
    return all_of(
        like_ascii(F.col("title"), keyword, literal) | like_ascii(F.col("ocr_text"), keyword, literal) if keyword else None,
        like_ascii(F.col("title"), title, literal) if title else None,
        F.col("session_id") == session_id if session_id else None,
        F.col("game_title") == game if game else None,
    )


def search(screens: DataFrame, sessions: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """Newest matching screens (O1); ties by id."""
    return with_sessions(screens, sessions).where(matching(**filters)).orderBy(F.desc_nulls_last("discovered_at"), F.desc("id")).limit(clamp(limit, SEARCH_LIMIT))


def path_has_session(path: Column, session: Column) -> Column:
    """A path that runs through a session's folder (P5)."""
    return path.contains(F.concat(F.lit("/"), session, F.lit("/")))


def ranked(screens: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Screens with a token that the last word of the keyword begins, or that is one of its other words, best first.

    Relevance: for each word, its count in the text times the square of log10(N / documents that have it), summed. A
    scan; the table of counts is as small as the keyword.
    """
    asked = keyword.lower().split()
    if not asked:
        return screens.limit(0).withColumn("relevance", F.lit(0.0))
    tokens = F.split(F.lower(F.coalesce("ocr_text", F.lit(""))), " ")
    hit = [(lambda t, w=w: t.startswith(w)) if i == len(asked) - 1 else (lambda t, w=w: t == w) for i, w in enumerate(asked)]

    def count(i: int) -> Column:
        return F.size(F.filter(tokens, lambda t: hit[i](t)))

    counted = screens.withColumns({f"_tf{i}": count(i) for i in range(len(asked))})
    totals = counted.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))]).first()
    weights = [0.0 if not totals[f"_df{i}"] else math.log10(totals["_n"] / totals[f"_df{i}"]) ** 2 for i in range(len(asked))]
    relevance = reduce(lambda a, b: a + b, [F.col(f"_tf{i}") * F.lit(w) for i, w in enumerate(weights)])
    some = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(asked))])
    return counted.where(some).withColumn("relevance", F.round(relevance, 6)).drop(*[f"_tf{i}" for i in range(len(asked))]).orderBy(F.desc("relevance"), F.desc_nulls_last("discovered_at"), F.desc("id")).limit(clamp(limit, SEARCH_LIMIT))


def coverage(screens: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct fingerprints, greatest depth (0 for none) and distinct sessions; one row if not by group."""
    aggs = [F.countDistinct("fingerprint").alias("unique_screens"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.countDistinct("session_id").alias("sessions")]
    return screens.groupBy(by).agg(*aggs) if by else screens.agg(*aggs)


def project_screens(screens: DataFrame) -> DataFrame:
    """One row per fingerprint of a project: smallest id, depth and time, and the fields of the row of least (depth,
    time, id) (A3, N12)."""
    best = F.min_by(F.struct("title", "session_id", "phash"), F.struct(F.coalesce("depth", F.lit(2**31 - 1)), F.coalesce("discovered_at", F.lit("￿")), "id"))
    return screens.groupBy("fingerprint").agg(F.min("id").alias("first_id"), F.min("depth").alias("min_depth"), F.min("discovered_at").alias("first_seen"), best.alias("b")).select("fingerprint", "first_id", "min_depth", "first_seen", F.col("b.title").alias("title"), F.col("b.session_id").alias("session_id"), F.col("b.phash").alias("phash"))


def parents_of(screens: DataFrame) -> DataFrame:
    """(id, parent_id): the first row of the same session that has the parent's fingerprint."""
    first = screens.where("fingerprint is not null").groupBy("session_id", F.col("fingerprint").alias("parent_fp")).agg(F.min("id").alias("parent_id"))
    return screens.select("id", "session_id", "parent_fp").join(first, ["session_id", "parent_fp"], "left").select("id", "parent_id")


def known_hashes(screens: DataFrame) -> DataFrame:
    """Distinct hashes of each game's earlier screens."""
    return screens.where("phash is not null and phash <> ''").select("game_title", "phash").distinct()


def known_ratio(found: Column, skipped: Column) -> Column:
    """Percent of screens met again, halves to even; 0 without any."""
    return F.bround(F.coalesce(F.try_divide(skipped * 100.0, found + skipped), F.lit(0.0)), 0).cast("long")


def api_rows(screens: DataFrame) -> DataFrame:
    """Rows as the service shows them (P10): screens with their session."""
    return screens.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), F.lit("unknown")).alias("name"), F.concat(F.lit("depth="), F.coalesce("depth", F.lit(0))).alias("category"), F.col("screenshot_path"), F.lit(None).cast("string").alias("thumbnail_path"), F.lit(1).alias("visited_count"), F.col("discovered_at").alias("last_seen_at"), "game_title", F.lit("ios").alias("platform")
    )


def image_type(path: Column, roots: list[str]) -> Column:
    """MIME type of an image under one of the roots; null outside them, for ways up, and for other files."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "gif", "image/gif")
    inside = reduce(lambda a, b: a | b, [path.startswith(r) for r in roots], F.lit(False))
    return F.when(inside & ~path.contains(".."), mime)


def by_id(df: DataFrame, row_id: int) -> DataFrame:
    """The row of an id (P9); ids are positive. The filter reaches the scan."""
    if row_id <= 0:
        raise ValueError("an id is positive")
    return df.where(F.col("id") == row_id).limit(1)


def filtered(rows: DataFrame, title: str | None = None, keyword: str | None = None) -> DataFrame:
    """Rows whose name or text contains each of the given strings, whatever their case (P8). '' and '0' don't count as
    given; % and _ are plain characters."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    found = [text("name").contains(k.lower()) | text("ocr_text").contains(k.lower()) for k in (title, keyword) if k not in (None, "", "0")]
    return rows.where(all_of(*found))


def with_games(screens: DataFrame, games: DataFrame) -> DataFrame:
    """Screens whose game is in the catalogue, with its id and platform (J1). games: id, name, platform; unique names."""
    g = games.select(F.col("name").alias("game_title"), F.col("id").alias("game_id"), "platform")
    return screens.join(g, "game_title")


def elements(items: DataFrame, names: DataFrame) -> DataFrame:
    """Elements with the name of the screen they lead to, null if there is none, and their place on their screen by y,
    x and id (J4, O4). items: id, screen_id, bbox_x, bbox_y, navigates_to; names: id, name."""
    n = names.select(F.col("id").alias("navigates_to"), F.col("name").alias("target_name"))
    place = F.row_number().over(Window.partitionBy("screen_id").orderBy("bbox_y", "bbox_x", "id"))
    return items.join(n, "navigates_to", "left").withColumn("place", place)


def items_of_screen(items: DataFrame, screen_id: int) -> DataFrame:
    """A screen's items in order of id (J9). The filter reaches the scan."""
    return items.where(F.col("screen_id") == screen_id).orderBy("id")


def item_counts(screens: DataFrame, items: DataFrame) -> DataFrame:
    """(id, n_items, best) of every screen (J9); items are counted per screen before they are joined."""
    n = items.groupBy(F.col("screen_id").alias("id")).agg(F.count("*").alias("n_items"), F.max("confidence").alias("best"))
    return screens.select("id").join(n, "id", "left").select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "best")


def project_list(projects: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The first rows of project_screens() by depth, time and fingerprint (O3)."""
    return projects.orderBy(F.asc_nulls_last("min_depth"), F.asc_nulls_last("first_seen"), "fingerprint").limit(clamp(limit, LIST_LIMIT))


def by_depth(screens: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The first screens by depth and title, in order of position on ties."""
    return screens.orderBy(F.asc_nulls_last("depth"), F.asc_nulls_last("title"), "id").limit(clamp(limit, LIST_LIMIT))


def most_urgent(df: DataFrame, priority: str, area: str, limit: int = 20) -> DataFrame:
    """Candidates of the highest priority, the largest first among equals (O8); ties by id."""
    return df.orderBy(F.desc(priority), F.desc(area), "id").limit(clamp(limit, SEARCH_LIMIT))


def titles(sessions: DataFrame) -> DataFrame:
    """Distinct titles (A4)."""
    return sessions.where("game_title is not null").select("game_title").distinct()


def panel(sessions: DataFrame, games: DataFrame) -> DataFrame:
    """Crawl sessions with their game and folder (J2). Whether the games are broadcast is left to their measured size."""
    g = games.select(F.col("id").alias("game_id"), F.col("name").alias("game_name"), "platform")
    return sessions.join(g, "game_id").select("id", "game_name", "platform", "status", "screens_found", "ended_at", F.coalesce(session_dir(F.col("ended_at")), F.lit("running")).alias("session_dir"))


def newest(panel_: DataFrame, limit: int = 20) -> DataFrame:
    """Panel rows by end, running ones last (O1)."""
    return panel_.orderBy(F.desc_nulls_last("ended_at"), F.desc("id")).limit(clamp(limit, SEARCH_LIMIT))


def running(sessions: DataFrame, by: str) -> DataFrame:
    """Running, completed and all sessions per key."""
    return sessions.groupBy(by).agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "completed").alias("completed"), F.count("*").alias("total"))


#: Icons of states and device modes.
STATUS_ICONS = {"running": "🟢", "completed": "✅", "failed": "❌", "paused": "⏸"}
MODE_ICONS = {"MIRROR": "📡", "SIMULATOR": "🖥"}


def icon(c: Column, icons: dict[str, str]) -> Column:
    """Icon of a value, '' for others and null."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in icons.items() for x in kv]), c), F.lit(""))
