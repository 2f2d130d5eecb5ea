"""Text requests for the five tasks, one row per case and context level.

Every text is one column expression over an already joined case row; absent
sections are NULL and vanish when the sections are joined. Histories are arrays
of at most 15 entries and candidate lists of at most 20.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import CELL_LABEL_PLACES, KM_PER_MILE, cell, cell_pair_label
from placewise.functions.numbers import fixed, hash_key, ratio_or_zero, thousands
from placewise.functions.texts import UNKNOWN, category_title, day_name, numbered_lines, sections
from placewise.sources.sinks import chat_messages

from .levels import LEVELS

# The wording of instructions, questions and headings below.
FRIENDSHIP_SYSTEM = {
    "venue_id": (
        "You are an expert at predicting social relationships from location data. "
        "Given information about two users' check-in patterns, predict whether "
        "they are friends. Answer ONLY 'Yes' or 'No'."
    ),
    "latlng": (
        "You are an expert at predicting social relationships from location data. "
        "Given information about two users' check-in coordinate patterns, predict "
        "whether they are friends. Answer ONLY 'Yes' or 'No'."
    ),
    "enriched": (
        "You are an expert at predicting social relationships from location data. "
        "Given information about two users' check-in patterns and venue preferences, "
        "predict whether they are friends. Answer ONLY 'Yes' or 'No'."
    ),
}
FRIENDSHIP_QUESTION = "Are these two users friends? Answer ONLY 'Yes' or 'No'."
NEXT_PLACE_SYSTEM = (
    "You are an expert at predicting location visits from check-in data. "
    "Given a user's check-in history and a candidate venue, predict whether "
    "the user will visit this venue next. Answer ONLY 'Yes' or 'No'."
)
NEXT_PLACE_QUESTION = "Will this user visit this venue next? Answer ONLY 'Yes' or 'No'."
OD_QUESTION = "Question: Is this candidate the next dropoff zone? Answer Yes or No."
DURATION_QUESTION = "Question: Predict the trip duration in minutes. Answer with a number only."
RATING_SYSTEM = (
    "You are an expert restaurant and business rating predictor. "
    "Given information about a user and a target business, predict the star rating "
    "the user would give (1 to 5 stars, integers only). "
    "Return ONLY a single integer from 1 to 5. No explanation."
)
RATING_QUESTION = (
    "Predict the star rating (1-5) this user would give. Return ONLY a single integer."
)
RATING_REASONING = (
    "Reason briefly about what star rating this user would give to this business and why."
)
BUSINESS_SYSTEM = (
    "You are an expert business recommendation system. "
    "Given information about a user and a list of candidate businesses, "
    "rank the candidates from most to least likely for the user to visit next. "
    "Return ONLY a JSON list of candidate numbers in ranked order, e.g. [3, 1, 7, ...]. "
    "Do not include any explanation."
)
BUSINESS_REASONING = "Reason briefly about how likely this user is to visit this business next."
TRAJECTORY_SYSTEM = (
    "You are an expert location recommendation system. "
    "Given information about a user and a list of candidate places, "
    "rank the candidates from most to least likely for the user to visit next. "
    "Return ONLY a JSON list of candidate numbers in ranked order, e.g. [3, 1, 7, ...]. "
    "Do not include any explanation."
)
OD_SYSTEM = (
    "You are a transportation analyst. Given information about a taxi trip "
    "origin zone and a candidate dropoff zone, determine if this candidate "
    "is the actual next dropoff. Answer only Yes or No."
)
DURATION_SYSTEM = (
    "You are a transportation analyst. Given information about a taxi trip, "
    "predict the trip duration in minutes. Answer with a number only."
)
RATING_REASONING_SYSTEM = (
    "You are an expert at analyzing user preferences. "
    "Given information about a user and a target business, "
    "reason briefly (2-3 sentences) about what star rating this user "
    "would likely give and why. Consider their history, category "
    "preferences, and alignment with the business."
)
BUSINESS_REASONING_SYSTEM = (
    "You are an expert at predicting user behavior. "
    "Given information about a user and a candidate business, "
    "reason briefly (1-2 sentences) about how likely this user is "
    "to visit this business next and why."
)
NO_CONTEXT = "No user context available."
UTC_SUFFIX = "+00:00"

TextByLevel = Callable[[str], Column]


def at_least(level: str, lowest: str) -> bool:
    return LEVELS.index(level) >= LEVELS.index(lowest)


def one_row_per_level(rows: DataFrame, keys: Sequence[str], text: TextByLevel, levels: Sequence[str] = LEVELS) -> DataFrame:
    """All wanted levels of each case from one pass over the joined rows."""
    items = [F.struct(F.lit(g).alias("level"), text(g).alias("text")) for g in levels]
    return rows.select(*keys, F.explode(F.array(*items)).alias("_t")).select(*keys, "_t.level", "_t.text")


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _point(lat: Column, lon: Column, places: int, gap: str = ", ") -> Column:
    return _say("(", fixed(lat, places), gap, fixed(lon, places), ")")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def _category_shares(top: Column, known: Column) -> Column:
    """``Bar (40%), Park (20%)``; empty text when nothing is known."""
    total = F.greatest(known, F.lit(1))
    return F.array_join(
        F.transform(top, lambda c: _say(category_title(c["category"]), " (", fixed(c["n"] * 100.0 / total, 0), "%)")),
        ", ",
    )


def _stop(tier: str, level: str) -> Callable[[Column], Column]:
    """One line of a check-in history."""

    def render(c: Column) -> Column:
        places = 3 if tier == "latlng" else 4
        where = _say("at ", _point(c["latitude"], c["longitude"], places))
        if tier == "venue_id":
            where = _say("Location ", c["location_id"], " ", where)
        elif tier == "enriched":
            where = _say(category_title(c["category"]), " ", where)
        return _say("[", iso_time(c["ts"]), "] ", where) if level == "G4" else where

    return render


def _person(tag: str, owner: str, suffix: str, tier: str, level: str) -> Column:
    """Description of one user; ``suffix`` picks the user's columns.

    ``owner`` is how the recent list is introduced ("User A recent", "User's recent").
    """

    def c(name: str) -> Column:
        return F.col(name + suffix)

    areas, noun = (c("unique_cells"), "areas") if tier == "latlng" else (c("unique_locations"), "locations")
    if level == "G0":
        return _say(f"{tag}: ", c("total_checkins"), " total check-ins across ", areas, f" unique {noun}.")
    parts = [_say(f"{tag} is primarily active in region ", c("primary_region"), ".")]
    if tier == "enriched":
        shares = _category_shares(c("top_categories"), c("known_visits"))
        parts.append(F.when(shares != "", _say(f"{tag} frequently visits: ", shares, ".")))
    if at_least(level, "G2"):
        # Only the two-user texts count venue categories here.
        kinds: list = []
        if tier == "enriched" and suffix:
            kinds = [c("unique_categories"), " venue categories, "]
        parts.append(
            _say(f"{tag} statistics: ", c("total_checkins"), " total check-ins, ", areas, f" unique {noun}, ",
                 *kinds, "geographic spread ", fixed(c("geo_spread_km"), 1), " km, active for ",
                 c("active_days"), " days.")
        )
    if at_least(level, "G3"):
        recent = c("recent")
        parts.append(
            _say(f"{owner} ", F.size(recent), " check-ins:\n", numbered_lines(recent, _stop(tier, level)))
        )
    return sections(*parts, separator="\n")


def _pair_statistics(tier: str, level: str) -> Column | None:
    if not at_least(level, "G2"):
        return None
    if tier == "latlng":
        lines = [
            _say("Approximate shared areas: ", F.col("shared_cells")),
            _say("Area overlap (Jaccard): ", fixed("jaccard_cells", 4)),
        ]
        met = _say("Approximate temporal co-visits (nearby within 1h): ", F.col("temporal_co_cells"))
    else:
        lines = [
            _say("Shared locations: ", F.col("shared_locations")),
            _say("Location Jaccard similarity: ", fixed("jaccard_locations", 4)),
        ]
        met = _say("Temporal co-occurrences (same location within 1h): ", F.col("temporal_co_occurrences"))
    if tier == "enriched":
        lines += [
            _say("Shared venue categories: ", F.col("shared_categories")),
            _say("Category similarity (Jaccard): ", fixed("category_jaccard", 4)),
        ]
    lines += [
        _say("Distance between centroids: ", fixed("centroid_distance_km", 1), " km"),
        _say("Same primary region: ", _yes_no(F.col("same_region") == 1)),
    ]
    if tier == "enriched":
        lines.append(_say("Same top venue category: ", _yes_no(F.col("same_top_category") == 1)))
    if level == "G4":
        lines.append(met)
    return _say("Pair statistics:\n", sections(*[_say("  - ", x) for x in lines], separator="\n"))


def friendship_rows(measures: DataFrame, recent: DataFrame, category_profiles: DataFrame | None = None) -> DataFrame:
    """Pair measures with both recent histories (and category profiles) attached."""
    rows = measures
    for s in ("a", "b"):
        r = recent.select(F.col("user_id").alias(f"user_{s}"), F.col("recent").alias(f"recent_{s}"))
        rows = rows.join(r, f"user_{s}", "left")
        if category_profiles is not None:
            p = category_profiles.select(
                F.col("user_id").alias(f"user_{s}"),
                F.col("top_categories").alias(f"top_categories_{s}"),
                F.col("known_visits").alias(f"known_visits_{s}"),
            )
            rows = rows.join(p, f"user_{s}", "left")
    return rows


def friendship_body(tier: str, level: str) -> Column:
    """Everything before the question."""
    parts = [
        _person("User A", "User A recent", "_a", tier, level),
        _person("User B", "User B recent", "_b", tier, level),
    ]
    pair = _pair_statistics(tier, level)
    return sections(*parts, *([] if pair is None else [pair]))


def friendship_texts(rows: DataFrame, keys: Sequence[str], tier: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    return one_row_per_level(
        rows, keys, lambda g: sections(friendship_body(tier, g), F.lit(FRIENDSHIP_QUESTION)), levels
    )


def few_shot_prefix(examples: DataFrame, tier: str, seed: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """One text per level showing the labelled example pairs, without their question.

    ``examples`` is a handful of rows chosen with ``sampling.balanced``.
    """
    bodies = one_row_per_level(
        examples, ["user_a", "user_b", "label"], lambda g: friendship_body(tier, g), levels
    )
    order = hash_key(seed, "user_a", "user_b")
    packed = bodies.groupBy("level").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("k"), "text", "label"))).alias("_e")
    )
    shown = F.transform(
        "_e",
        lambda e, i: _say("--- Example ", i + 1, " ---\n", e["text"], "\nAnswer: ", _yes_no(e["label"] == 1), "\n"),
    )
    head = _say("Here are ", F.size("_e"), " labeled examples:\n")
    return packed.select("level", sections(head, F.array_join(shown, "\n"), separator="\n").alias("prefix"))


def with_few_shots(texts: DataFrame, prefix: DataFrame) -> DataFrame:
    """Put the examples of the same level before each request (one row a level is looked up)."""
    return texts.join(prefix, "level").withColumn(
        "text", sections("prefix", F.lit("--- Now predict for this new pair ---"), "text", separator="\n")
    ).drop("prefix")


def user_summary(tier: str, level: str, suffix: str = "") -> Column:
    """Short one-line description of a user, used as embedding text."""

    def c(name: str) -> Column:
        return F.col(name + suffix)

    if level == "G0":
        return _say("User with ", c("total_checkins"), " check-ins")
    parts = [_say("Region: ", c("primary_region"))]
    enriched = tier == "enriched"
    if enriched:
        shares = _category_shares(c("top_categories"), c("known_visits"))
        parts.append(F.when(shares != "", _say("Top venues: ", shares)))
    if at_least(level, "G2"):
        kinds = [c("unique_categories"), " venue categories, "] if enriched else []
        parts.append(
            _say("Stats: ", c("total_checkins"), " check-ins, ", c("unique_locations"), " unique locations, ",
                 *kinds, "spread ", fixed(c("geo_spread_km"), 1), " km, ", c("active_days"), " active days")
        )
    if at_least(level, "G3"):

        def stop(x: Column) -> Column:
            name = _say(category_title(x["category"]), " ") if enriched else _say("Loc", x["location_id"], " ")
            line = _say(name, _point(x["latitude"], x["longitude"], 4, ","))
            return _say("[", iso_time(x["ts"]), "] ", line) if level == "G4" else line

        parts.append(_say("Recent: ", F.array_join(F.transform(c("recent"), stop), "; ")))
    return sections(*parts, separator=". ")


def next_place_texts(rows: DataFrame, keys: Sequence[str], tier: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Rows hold the profile, ``recent``, the candidate (``location_id, lat, lon``), ``visits``
    (at the place, or at the cell for latlng), ``centre_km``, and for the enriched tier
    ``category``, ``cat_n``, ``known_visits`` and ``top_categories``."""
    lat, lon = F.col("lat"), F.col("lon")
    if tier == "latlng":
        candidate = _say("Candidate venue at ", _point(lat, lon, 3), ".")
    else:
        name = _say("Location ", F.col("location_id"))
        if tier == "enriched":
            name = _say(category_title("category"), " (", name, ")")
        candidate = _say("Candidate: ", name, " at ", _point(lat, lon, 4), ".")
    place = "area" if tier == "latlng" else "venue"

    def visit_lines(level: str) -> Column | None:
        if level == "G0":
            return None
        region = cell_pair_label(cell("lat", CELL_LABEL_PLACES), cell("lon", CELL_LABEL_PLACES), CELL_LABEL_PLACES)
        where = F.when(region == F.col("primary_region"), "in").otherwise("outside")
        lines = [
            _say("Candidate is ", where, " user's primary region."),
            _say("Distance from user's center of activity: ", fixed("centre_km", 1), " km."),
        ]
        if at_least(level, "G2"):
            lines.append(
                F.when(F.col("visits") > 0, _say(f"User has visited this {place} ", F.col("visits"), " time(s) before."))
                .otherwise(f"User has never visited this {place}.")
            )
            if tier == "enriched":
                share = F.col("cat_n") * 100.0 / F.greatest(F.col("known_visits"), F.lit(1))
                lines.append(
                    F.when(
                        F.col("category") != UNKNOWN,
                        _say("User has visited ", category_title("category"), " venues ", F.col("cat_n"),
                             " time(s) (", fixed(share, 0), "% of check-ins)."),
                    )
                )
        return sections(*lines, separator="\n")

    def text(level: str) -> Column:
        visits = visit_lines(level)
        return sections(
            _person("User", "User's recent", "", tier, level),
            candidate,
            *([] if visits is None else [visits]),
            F.lit(NEXT_PLACE_QUESTION),
        )

    return one_row_per_level(rows, keys, text, levels)


def _zone(prefix: str, zone: str, tier: str) -> Column:
    parts = [_say("Zone ", F.col(zone), " (", F.coalesce(F.col(f"{prefix}_borough"), F.lit("Unknown")), ")")]
    if tier == "enriched":
        title = lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
        main, names = F.col(f"{prefix}_cat"), F.slice(F.col(f"{prefix}_cats"), 1, 5)
        parts.append(F.when(main != UNKNOWN, _say("Primary category: ", title(main))))
        nearby = _say("Nearby POIs: ", F.array_join(F.transform(names, title), ", "))
        parts.append(F.when((main != UNKNOWN) & (F.size(names) > 1), nearby))
    return sections(*parts, separator=". ")


def _int(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _area_line(a: str, b: str) -> Column:
    same = (F.col(f"{a}_borough") == F.col(f"{b}_borough")) & (F.col(f"{a}_borough") != "")
    return _say("Same borough: ", _yes_no(same), ". Distance: ", fixed("distance_km", 1), " km.")


def od_texts(rows: DataFrame, keys: Sequence[str], tier: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Drop-off requests from cases joined with both zones (``o_``, ``c_``) and trip statistics."""

    def text(level: str) -> Column:
        lines = [
            _say("Origin: ", _zone("o", "origin_zone", tier)),
            _say("Origin has ", thousands(_int("pu_count")), " total trips to ", _int("unique_dropoffs"),
                 " distinct dropoff zones."),
            _say("Candidate: ", _zone("c", "candidate_zone", tier)),
            _say("Candidate dropoff popularity: ", thousands(_int("do_count")), " trips."),
        ]
        if at_least(level, "G1"):
            lines.append(_area_line("o", "c"))
        if at_least(level, "G2"):
            lines.append(
                _say("Origin geo-spread: ", fixed(F.coalesce("geo_spread", F.lit(0.0)), 1), " km. Active days: ",
                     _int("active_days"), ". Trips from origin to candidate: ", _int("od_count"), ".")
            )
        if at_least(level, "G3"):
            zones = F.array_join(F.transform("recent", lambda r: r["do_zone"].cast("string")), ", ")
            lines.append(F.when(F.size("recent") > 0, _say("Recent 5 dropoff zones from origin: ", zones, ".")))
        if level == "G4":
            mean = F.coalesce("mean_hour", F.lit(12.0))
            lines.append(
                _say("Mean dropoff hour: ", fixed(mean, 1), " (std: ", fixed(F.coalesce("std_hour", F.lit(0.0)), 1), ").")
            )
        return sections(*lines, F.lit(OD_QUESTION), separator="\n")

    return one_row_per_level(rows, keys, text, levels)


def duration_texts(rows: DataFrame, keys: Sequence[str], tier: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Duration requests from cases joined with both zones (``o_``, ``d_``) and trip statistics."""

    def number(c: str, places: int) -> Column:
        return fixed(F.coalesce(F.col(c), F.lit(0.0)), places)

    def text(level: str) -> Column:
        lines = [
            _say("Origin: ", _zone("o", "pu_zone", tier)),
            _say("Destination: ", _zone("d", "do_zone", tier)),
            _say("Origin has ", thousands(_int("pu_count")), " trips (mean duration: ", number("pu_mean_dur", 1),
                 " min). Destination has ", thousands(_int("do_count")), " arrivals (mean duration: ",
                 number("do_mean_dur", 1), " min)."),
        ]
        if at_least(level, "G1"):
            lines.append(_area_line("o", "d"))
        if at_least(level, "G2"):
            km = fixed(F.coalesce("trip_distance", F.lit(0.0)) * KM_PER_MILE, 1)
            lines.append(
                _say("Trips on this OD pair: ", _int("od_count"), " (mean duration: ", number("od_mean_dur", 1),
                     " min). Trip distance: ", km, " km.")
            )
        if at_least(level, "G3"):
            minutes = F.array_join(F.transform("recent", lambda r: fixed(r["duration_min"], 0)), ", ")
            lines.append(F.when(F.size("recent") > 0, _say("Recent 5 trip durations from origin: ", minutes, " min.")))
        if level == "G4":
            lines.append(
                _say("Pickup: ", day_name("pickup_dow"), " at ", F.format_string("%02d", "pickup_hour"),
                     ":00. Mean duration from origin at this hour: ", number("hour_mean", 1), " min.")
            )
        return sections(*lines, F.lit(DURATION_QUESTION), separator="\n")

    return one_row_per_level(rows, keys, text, levels)


# -- reviews ---------------------------------------------------------------


def _profile_lines(profile: Column, dots: bool = True) -> Column:
    """Up to 15 most reviewed categories. ``profile`` is sorted, items (category, n, avg_stars)."""
    lines = F.transform(
        F.slice(profile, 1, 15),
        lambda p: _say("  - ", p["category"], ": ", p["n"], " visits, avg ", fixed(p["avg_stars"], 1), " stars"),
    )
    listed = F.array_join(lines, "\n")
    if not dots:
        return listed
    rest = F.when(F.size(profile) > 15, _say("  - ... and ", F.size(profile) - 15, " other categories"))
    return sections(listed, rest, separator="\n")


def _review_line(level: str, gap: str = ", ") -> Callable[[Column], Column]:
    def render(r: Column) -> Column:
        what = _say(r["business_name"], " (", r["categories"], ")")
        if level == "G4":
            day = F.date_format(r["review_date"], "yyyy-MM-dd")
            what = _say("[", day, "] ", what, " at ", _point(r["latitude"], r["longitude"], 4, gap))
        return _say(what, " -> ", r["stars"], " stars")

    return render


def _user_review_sections(level: str, noun: str) -> list[Column]:
    """City, category profile and recent reviews of the user of a case row."""
    parts: list[Column] = []
    if at_least(level, "G1"):
        city = F.when(F.col("city") != "", F.col("city")).otherwise(
            F.coalesce(F.nullif(F.try_element_at("recent", F.lit(-1))["city"], F.lit("")), F.lit("Unknown"))
        )
        parts.append(_say("The user is located in ", city, "."))
    if at_least(level, "G2"):
        some = F.size("profile") > 0
        parts.append(F.when(some, "The user's review history by category (visits and average rating):"))
        parts.append(F.when(some, _profile_lines(F.col("profile"))))
    if at_least(level, "G3"):
        some = F.size("recent") > 0
        extra = " with locations and dates" if level == "G4" else ""
        parts.append(
            F.when(some, _say("The user's ", F.size("recent"), f" most recent {noun}{extra} (oldest to newest):"))
        )
        parts.append(F.when(some, numbered_lines(F.col("recent"), _review_line(level))))
    return parts


def _business(name: Column, categories: Column, lat: Column, lon: Column, level: str) -> Column:
    text = _say('"', name, '" (Categories: ', categories, ")")
    return _say(text, " at ", _point(lat, lon, 4)) if level == "G4" else text


def _own_business(level: str) -> Column:
    return _business(*map(F.col, ("business_name", "categories", "latitude", "longitude")), level)


def rating_texts(rows: DataFrame, keys: Sequence[str], question: str = RATING_QUESTION, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Star requests from target rows with ``profile`` and ``recent``.

    Pass ``RATING_REASONING`` as the question for the reasoning form.
    """

    def text(level: str) -> Column:
        return sections(
            *_user_review_sections(level, "reviews"),
            _say("Target business: ", _own_business(level)),
            F.lit(question),
        )

    return one_row_per_level(rows, keys, text, levels)


def rating_text_parts(rows: DataFrame, keys: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """User text and business text of the same requests, apart, for embedding."""
    items = []
    for g in levels:
        user = sections(*_user_review_sections(g, "reviews"))
        items.append(
            F.struct(
                F.lit(g).alias("level"),
                F.when(user != "", user).otherwise(NO_CONTEXT).alias("user_text"),
                _say("Target business: ", _own_business(g)).alias("item_text"),
            )
        )
    return rows.select(*keys, F.explode(F.array(*items)).alias("_t")).select(*keys, "_t.*")


def business_ranking_texts(rows: DataFrame, keys: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """Ranking requests; ``candidates`` is the ordered candidate array."""

    def text(level: str) -> Column:
        def line(c: Column) -> Column:
            what = _say(c["business_name"], " (", c["categories"], ")")
            return _say(what, " at ", _point(c["latitude"], c["longitude"], 4)) if level == "G4" else what

        return sections(
            *_user_review_sections(level, "visits"),
            F.lit("Candidate businesses to rank:"),
            numbered_lines(F.col("candidates"), line),
            _say("Rank all ", F.size("candidates"), " candidates from most to least likely for this user "
                 "to visit next. Return ONLY a JSON list of candidate numbers (1-indexed)."),
        )

    return one_row_per_level(rows, keys, text, levels)


def business_reasoning_texts(rows: DataFrame, keys: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """Reasoning requests, one per user and candidate (candidate columns prefixed ``cand_``)."""

    def text(level: str) -> Column:
        parts: list[Column] = []
        if at_least(level, "G1"):
            parts.append(_say("The user is located in ", F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("Unknown")), "."))
        if at_least(level, "G2"):
            parts.append(
                F.when(F.size("profile") > 0, _say("The user's review history by category:\n",
                                                   _profile_lines(F.col("profile"), dots=False)))
            )
        if at_least(level, "G3"):
            parts.append(
                F.when(F.size("recent") > 0, _say("Recent ", F.size("recent"), " visits:\n",
                                                  numbered_lines(F.col("recent"), _review_line(level))))
            )
        user = sections(*parts)
        user = F.when(user != "", user).otherwise(NO_CONTEXT)
        what = _business(*map(F.col, ("cand_business_name", "cand_categories", "cand_latitude", "cand_longitude")), level)
        return sections(user, _say("Candidate business: ", what), F.lit(BUSINESS_REASONING))

    return one_row_per_level(rows, keys, text, levels)


def business_user_summaries(rows: DataFrame, keys: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """One-line user texts for embedding."""

    def text(level: str) -> Column:
        parts: list[Column] = []
        if at_least(level, "G1"):
            parts.append(_say("User located in ", F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("Unknown")), "."))
        if at_least(level, "G2"):
            items = F.transform(
                F.slice("profile", 1, 15),
                lambda p: _say(p["category"], ": ", p["n"], " visits, avg ", fixed(p["avg_stars"], 1), " stars"),
            )
            parts.append(F.when(F.size("profile") > 0, _say("Category history: ", F.array_join(items, "; "))))
        if at_least(level, "G3"):
            visits = F.array_join(F.transform("recent", _review_line(level, ",")), "; ")
            parts.append(F.when(F.size("recent") > 0, _say("Recent visits: ", visits)))
        user = sections(*parts, separator=" ")
        return F.when(user != "", user).otherwise(NO_CONTEXT)

    return one_row_per_level(rows, keys, text, levels)


def trajectory_texts(rows: DataFrame, keys: Sequence[str], city: str, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Ranking requests for sessions: ``profile`` (category, n), ``recent`` stops, ``candidates``."""

    def text(level: str) -> Column:
        def place(c: Column) -> Column:
            what = _say(c["category"], " (Venue ", c["location_id"], ")")
            return _say(what, " at ", _point(c["latitude"], c["longitude"], 4)) if level == "G4" else what

        def stop(c: Column) -> Column:
            time = F.date_format(c["ts"], "yyyy-MM-dd HH:mm:ss")
            return _say("[", time, UTC_SUFFIX, "] ", place(c)) if level == "G4" else place(c)

        parts: list[Column] = []
        if at_least(level, "G1"):
            parts.append(F.lit(f"The user is located in {city}."))
        if at_least(level, "G2"):
            some = F.size("profile") > 0
            lines = F.array_join(
                F.transform(F.slice("profile", 1, 15), lambda p: _say("  - ", p["category"], ": ", p["n"], " visits")), "\n"
            )
            rest = F.when(F.size("profile") > 15, _say("  - ... and ", F.size("profile") - 15, " other categories"))
            parts.append(F.when(some, "The user's historical visit profile (category: visit count):"))
            parts.append(F.when(some, sections(lines, rest, separator="\n")))
        if at_least(level, "G3"):
            extra = " with locations and timestamps" if level == "G4" else ""
            parts.append(_say("The user's ", F.size("recent"), f" most recent check-ins{extra} (oldest to newest):"))
            parts.append(numbered_lines(F.col("recent"), stop))
        return sections(
            *parts,
            F.lit("Candidate places to rank:"),
            numbered_lines(F.col("candidates"), place),
            _say("Rank all ", F.size("candidates"), " candidates from most to least likely for this user "
                 "to visit next. Return ONLY a JSON list of candidate numbers (1-indexed)."),
        )

    return one_row_per_level(rows, keys, text, levels)


def review_context(cases: DataFrame, history: DataFrame) -> DataFrame:
    """Cases with the user's ``recent`` reviews and sorted category ``profile``."""
    from placewise.operators.history import last_n_array

    from .reviews import MAX_RECENT, ORDER, category_profile

    fields = ["business_name", "categories", "city", "latitude", "longitude", "stars", "review_date"]
    recent = last_n_array(history, ["user_id"], ORDER, MAX_RECENT, fields, "recent")
    item = F.struct((-F.col("n")).alias("k"), "first_seen", "category", "n", "avg_stars")
    profile = category_profile(history).groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("profile"))
    rows = cases.join(recent, "user_id", "left").join(profile, "user_id", "left")
    return rows.withColumns({"recent": _or_empty(rows, "recent"), "profile": _or_empty(rows, "profile")})


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


def chat_rows(texts: DataFrame, system: str, answer: Column, split: Column) -> DataFrame:
    """Chat form of request rows: the answer turn for training rows only."""
    shown = F.when(split == "train", answer)
    return texts.withColumn("messages", chat_messages(F.lit(system), F.col("text"), shown)).drop("text")
