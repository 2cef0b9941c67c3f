"""Scalar expressions: vectors, text, times. All are built-in functions, so they stay in the JVM and in one stage."""

from __future__ import annotations

import re

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_vector(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, over the shorter length."""
    product = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity within -1 and 1; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def cosine_shorter(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity over the shorter length, not clamped; 0 if either is zero there."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    x, y = F.slice(_c(a), 1, n), F.slice(_c(b), 1, n)
    size = norm(x) * norm(y)
    return F.when((n <= 0) | (size == 0), 0.0).otherwise(dot(x, y) / size)


def normalized(v: Column | str) -> Column:
    """The vector at length 1; a zero vector, or one within 1e-6 of length 1, stays."""
    n = norm(v)
    return F.when((n == 0) | (F.abs(n - 1) < 1e-6), F.transform(_c(v), lambda x: x.cast("double"))).otherwise(F.transform(_c(v), lambda x: x.cast("double") / n))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def unit_score(distance: Column | str) -> Column:
    """Cosine of two unit vectors from their distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - _c(distance) * _c(distance) / 2))


# Substrings of domains that are never collected.
BANKING = (
    "bank", "chase", "wellsfargo", "citibank", "bofa", "bankofamerica", "capitalone", "discover", "paypal", "venmo", "cashapp",
    "zelle", "schwab", "fidelity", "vanguard", "robinhood", "etrade", "tdameritrade", "coinbase", "binance", "kraken",
)
PRIVATE = ("incognito", "private", "inprivate")
# Applications of which no screen text is kept.
SKIPPED_APPS = (
    "Finder", "System Preferences", "System Settings", "loginwindow", "Dock", "", "1Password", "1Password 7 - Password Manager",
    "Bitwarden", "LastPass", "Dashlane", "Keychain Access", "KeePassXC", "NordPass",
)


def is_banking(domain: Column | str) -> Column:
    return F.coalesce(F.lower(_c(domain)).rlike("|".join(BANKING)), F.lit(False))


def is_private(title: Column | str) -> Column:
    return F.coalesce(F.lower(_c(title)).rlike("|".join(PRIVATE)), F.lit(False))


def is_skipped_app(app: Column | str) -> Column:
    return F.coalesce(_c(app), F.lit("")).isin(*SKIPPED_APPS)


def domain_of(url: Column | str) -> Column:
    """What stands between // and the next /; port and user stay. Without //, up to the first /."""
    u = _c(url)
    return F.split_part(F.when(u.contains("//"), F.split_part(u, F.lit("//"), F.lit(2))).otherwise(u), F.lit("/"), F.lit(1))


# What stands in addresses of video pages, what stands before a video's id there, and how titles are worded.
VIDEO_PAGES = ("youtube.com/watch", "youtu.be/")
VIDEO_MARKS = ("v=", "youtu.be/", "embed/")
VIDEO_ID, VIDEO_PREFIX = "YouTube Video (ID: {})", "YouTube: "
VIDEO_OPENINGS = ("youtube", "yt:")


def video_title(title: Column | str, url: Column | str) -> Column:
    """Titles of video pages say so: by the video's id where the title is missing or is the id, else with a prefix."""
    u, t = _c(url), F.coalesce(_c(title), F.lit(""))
    marks = "|".join(re.escape(m) for m in VIDEO_MARKS)
    vid = F.regexp_extract(u, rf"(?:{marks})([\w-]+)", 1)
    page = reduce(or_, (u.contains(p) for p in VIDEO_PAGES))
    before, after = VIDEO_ID.split("{}")
    return (
        F.when(F.coalesce(~page, F.lit(True)) | (vid == ""), _c(title))
        .when((t == "") | (t == "Untitled") | t.contains(vid), F.concat(F.lit(before), vid, F.lit(after)))
        .when(reduce(or_, (F.lower(t).startswith(o) for o in VIDEO_OPENINGS)), t)
        .otherwise(F.concat(F.lit(VIDEO_PREFIX), t))
    )


def hour_label(hour: Column | str) -> Column:
    """0 to 23 as 12 AM to 11 PM."""
    h = _c(hour)
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.when(h < 12, " AM").otherwise(" PM"))


def json_block(text: Column | str) -> Column:
    """From the first { to the last }; the text itself if it has none."""
    found = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)
    return F.when(found == "", _c(text)).otherwise(found)


def one_line(text: Column | str, most: int) -> Column:
    """White space collapsed, at most so many characters."""
    return F.left(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), F.lit(most))


def to_last_sentence(text: Column | str) -> Column:
    """Cut after the last sentence end; a text without one stays."""
    found = F.regexp_extract(_c(text), r"(?s)^.*[.!?]", 0)
    return F.when(found == "", _c(text)).otherwise(found)


def strip_prefix(line: Column | str) -> Column:
    """What follows the first '] '; a line without it stays."""
    c = _c(line)
    return F.when(F.instr(c, "] ") > 0, c.substr(F.instr(c, "] ") + 2, F.length(c))).otherwise(c)


def last_segment(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)


def slug(name: Column | str) -> Column:
    return F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_"))


def event_text(content: Column | str, *path: str) -> Column:
    return F.get_json_object(_c(content), "$." + ".".join(path))


def embedding_text() -> Column:
    """The text that stands for an event in embeddings. Columns event_type, raw_content, metadata, project."""
    raw, kind = F.col("raw_content"), F.col("event_type")
    files = F.slice(F.coalesce(F.from_json(event_text(raw, "files_changed"), "array<string>"), F.array().cast("array<string>")), 1, 20)
    browser = F.concat_ws(" | ", event_text(raw, "title"), event_text(raw, "domain"))
    commit = F.concat_ws(" | ", event_text(raw, "message"), F.when(F.size(files) > 0, F.concat(F.lit("files: "), F.array_join(files, ", "))), event_text(raw, "diff"))
    gist = F.col("metadata")["gist"]
    text = (
        F.when(kind == "browser", F.coalesce(F.nullif(browser, F.lit("")), raw))
        .when(kind == "terminal", F.coalesce(event_text(raw, "command"), raw))
        .when(kind.isin("git_commit", "git_stash"), F.coalesce(F.nullif(commit, F.lit("")), raw))
        .when((kind == "screen") & (gist != ""), F.concat(gist, F.lit(" | "), raw))
        .otherwise(raw)
    )
    project = F.col("project")
    return F.concat(F.trim(text), F.when(project != "", F.concat(F.lit(" ["), project, F.lit("]"))).otherwise(""))


def _detail() -> Column:
    raw, kind, meta = F.col("raw_content"), F.col("event_type"), F.col("metadata")
    blank = lambda c: F.coalesce(c, F.lit(""))
    title, domain = blank(event_text(raw, "title")), blank(event_text(raw, "domain"))
    is_json = F.try_parse_json(raw).isNotNull()
    files = F.slice(F.coalesce(F.from_json(event_text(raw, "files_changed"), "array<string>"), F.array().cast("array<string>")), 1, 5)
    message = blank(event_text(raw, "message"))
    app, window = blank(meta["app_name"]), blank(meta["window_title"])
    return (
        F.when(kind == "terminal", F.left(F.coalesce(event_text(raw, "command"), raw), F.lit(120)))
        .when((kind == "browser") & is_json, F.when(domain != "", F.concat(title, F.lit(" | "), domain)).otherwise(F.left(title, F.lit(80))))
        .when(kind == "browser", F.left(raw, F.lit(80)))
        .when(kind.isin("git_commit", "git_stash") & is_json, F.when(F.size(files) > 0, F.concat(message, F.lit(" | "), F.array_join(files, ", "))).otherwise(F.left(message, F.lit(120))))
        .when(kind.isin("screen", "window"), F.coalesce(meta["gist"], F.when(window != "", F.concat(app, F.lit(" — "), window)).otherwise(app)))
        .otherwise(F.left(raw, F.lit(120)))
    )


def stamp() -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm")


def line() -> Column:
    """One line for an event: [time] type: detail."""
    return F.concat(F.lit("["), stamp(), F.lit("] "), F.col("event_type"), F.lit(": "), F.coalesce(_detail(), F.lit("")))


def detail() -> Column:
    """The long form: commits with all files and their diff, windows with the text's first 300 characters."""
    raw, kind = F.col("raw_content"), F.col("event_type")
    blank = lambda c: F.coalesce(c, F.lit(""))
    files = F.array_join(F.from_json(event_text(raw, "files_changed"), "array<string>"), ", ")
    diff = blank(event_text(raw, "diff"))
    commit = F.concat(
        F.lit("["), stamp(), F.lit("] "), kind, F.lit(": "), F.trim(blank(event_text(raw, "message"))),
        F.coalesce(F.concat(F.lit(" ["), F.col("project"), F.lit("]")), F.lit("")),
        F.when(blank(files) != "", F.concat(F.lit("\nFiles: "), files)).otherwise(""),
        F.when(diff != "", F.concat(F.lit("\n\n"), diff)).otherwise(""),
    )
    snippet = F.left(F.when(F.instr(raw, ": ") > 0, raw.substr(F.instr(raw, ": ") + 2, F.length(raw))).otherwise(raw), F.lit(300))
    return (
        F.when(kind.isin("git_commit", "git_stash") & F.try_parse_json(raw).isNotNull(), commit)
        .when(kind.isin("screen", "window") & (snippet != ""), F.concat(line(), F.lit("\n"), snippet))
        .otherwise(line())
    )


def rerank_text() -> Column:
    """What a re-ranker reads of an event."""
    return F.left(strip_prefix(detail()), F.lit(2000))


def fts_text() -> Column:
    """What keyword search sees of an event."""
    meta = F.col("metadata")
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (F.col("raw_content"), F.col("summary"), meta["app_name"], meta["window_title"], meta["gist"], meta["domain"])))


def node_line() -> Column:
    """One line for a graph node (label, props)."""
    p = F.col("props")
    blank = lambda k: F.coalesce(p[k], F.lit(""))
    what = F.coalesce(p["gist"], F.when(blank("window_title") != "", F.concat(blank("app_name"), F.lit(" — "), blank("window_title"))).when(blank("app_name") != "", blank("app_name")).otherwise(blank("project")))
    return F.rtrim(F.concat(F.lit("["), hhmm(blank("timestamp")), F.lit("] "), F.coalesce(p["type"], F.col("label")), F.lit(": "), what))


def hhmm(ts: Column | str) -> Column:
    """Date and minute of an ISO time; ??:?? for what is too short."""
    t = _c(ts)
    return F.when(F.length(t) >= 16, F.concat(t.substr(1, 10), F.lit(" "), t.substr(12, 5))).otherwise("??:??")


def anchor_header(app: str | None, time: str | None) -> str:
    parts = [f"{k}={v}" for k, v in (("app", app), ("time", time)) if v is not None]
    return f" ({', '.join(parts)})" if parts else " (most recent)"


def recency(ts: Column | str, now: Column, weight: float, days: float) -> Column:
    """weight * exp(-age / days), age in whole seconds and never below 0; 0 without weight."""
    if weight <= 0:
        return F.lit(0.0)
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(_c(ts)))
    return F.lit(weight) * F.exp(-(age / 86400.0) / max(days, 0.001))


def rule_category() -> Column:
    """A category by rules alone. Columns event_type and raw_content."""
    kind, raw = F.col("event_type"), F.lower(F.coalesce(F.col("raw_content"), F.lit("")))
    return (
        F.when(kind.isin("git_commit", "git_stash", "git_staged"), "Coding")
        .when(kind == "terminal", F.when(raw.contains("test") | raw.contains("debug"), "Debugging").otherwise("Coding"))
        .when(kind == "browser", F.when(raw.contains("stackoverflow") | raw.contains("docs.") | raw.contains("github.com") | raw.contains("wikipedia"), "Research").otherwise("Other"))
        .when(kind == "note", "Writing")
        .otherwise("Other")
    )


def query_terms(text: str) -> list[str]:
    """Terms of a search text: letters and digits, two bytes or more, lower case, each once, in order."""
    terms, word = [], ""
    for ch in text + " ":
        if ch.isalnum():
            word += ch
        elif word:
            terms.append(word.lower())
            word = ""
    return list(dict.fromkeys(t for t in terms if len(t.encode()) >= 2))


def search_terms(text: Column | str) -> Column:
    """``query_terms`` of a column of search texts."""
    words = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda x: F.octet_length(x) >= 2))


def tokens(text: Column | str) -> Column:
    """Lower-case terms of two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)


def chunks(words: Column | str, most: int = 409, overlap: int = 100) -> Column:
    """Overlapping slices of a word array: each starts most - overlap after the last, the first to reach the end is the last."""
    w, step = _c(words), max(1, most - overlap)
    n = F.size(w)
    count = F.when(n <= most, 1).otherwise(F.ceil((n - most) / step) + 1)
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.slice(w, i * step + 1, F.lit(most)))


def epoch_micros(c: Column | str, offset_seconds: int) -> Column:
    """A time from microseconds since another epoch, ``offset_seconds`` before 1970."""
    return F.timestamp_micros(_c(c) - F.lit(offset_seconds * 1_000_000))


def local_day(ts: Column | str, zone: str) -> Column:
    """The date that a UTC time has in a zone."""
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def day_start(now: Column | str, zone: str, date: str | None = None) -> Column:
    """Midnight of a date, else of the date that ``now`` has in the zone, read as UTC: where a collection of "today" begins."""
    day = F.to_date(F.lit(date), "yyyy-MM-dd") if date is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}", date) else local_day(now, zone)
    return F.to_timestamp(day)


def local_midnight(date: Column | str, zone: str) -> Column:
    """The UTC time at which a date begins in a zone."""
    return F.to_utc_timestamp(F.to_timestamp(_c(date)), zone)


# Kinds of triggers and how thoroughly each makes the screen be read.
TRIGGERS = {
    "app_switch": "Full",
    "title_change": "Medium",
    "space_switch": "Full",
    "screen_lock": "None",
    "screen_unlock": "Full",
    "idle_resume": "Full",
    "poll_tick": "Light",
}


def trigger_depth(kind: Column | str) -> Column:
    """How thoroughly a trigger makes the screen be read; null for kinds that aren't known."""
    return F.create_map(*(F.lit(x) for pair in TRIGGERS.items() for x in pair))[_c(kind)]
