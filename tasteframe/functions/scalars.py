"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
KEY = ["tmdb_id", "media_type"]
#: Fixed values of the children's rule.
CHILDREN_CERTIFICATIONS = ["TV-Y", "TV-Y7", "TV-Y7-FV"]
OLDER_CERTIFICATIONS = ["PG-13", "R", "NC-17", "TV-14", "TV-MA"]
ANIMATION, FAMILY, KIDS = 16, 10751, 10762
#: Names of the catalogue's genres.
GENRES = {
    28: "Action", 12: "Adventure", 16: "Animation", 35: "Comedy", 80: "Crime", 99: "Documentary",
    18: "Drama", 10751: "Family", 14: "Fantasy", 36: "History", 27: "Horror", 10402: "Music",
    9648: "Mystery", 10749: "Romance", 878: "Science Fiction", 10770: "TV Movie", 53: "Thriller",
    10752: "War", 37: "Western", 10759: "Action & Adventure", 10762: "Kids", 10763: "News",
    10764: "Reality", 10765: "Sci-Fi & Fantasy", 10766: "Soap", 10767: "Talk", 10768: "War & Politics",
}
#: Fixed values of the shared-screen rule.
SCREENS = ["Roku", "tvOS", "webOS", "Tizen", "Vizio Blink", "Android TV"]
#: Weight of a term by its group's letter.
GROUP_WEIGHTS = {"k": 1.0, "g": 1.0, "c": 0.5, "d": 0.5, "l": 0.3, "r": 0.3, "t": 0.3, "y": 0.3, "o": 1.0}


def shared_screen(product: str = "product", player: str = "player", platform: str = "platform") -> Column:
    """H9: played on a shared screen; null if only nulls speak."""
    return F.col(product).ilike("%TV%") | F.col(player).ilike("%BRAVIA%") | F.col(platform).isin(SCREENS)


def engagement(media: str, plays: str, episodes: str, percent: str, last_at: str, now: int) -> tuple[Column, Column]:
    """B2: engagement 0..1 and label of a title for a user."""
    stale = (F.lit(now) - F.col(last_at)) > 60 * DAY
    movie, watched, enough = F.col(media) == "movie", F.col(plays) > 0, F.col(episodes) >= 3
    level = F.when(movie, F.when(watched, 1.0).otherwise(0.0)).when(enough, F.least(F.lit(1.0), F.col(episodes) / 8)).otherwise(0.0)
    label = (
        F.when(movie & watched, "positive")
        .when(movie & (F.col(percent) < 30) & stale, "weak_negative")
        .when(movie, "neutral")
        .when(enough, "positive")
        .when(stale, "weak_negative")
        .otherwise("neutral")
    )
    return level, label


def half_life(days: Column, length: float) -> Column:
    return F.pow(F.lit(0.5), days / length)


def recency(first_at: Column, cutoff: Column) -> Column:
    """H1: a slow half-life and a short boost."""
    days = F.greatest(F.lit(0.0), (cutoff - first_at) / F.lit(DAY))
    return half_life(days, 730.0) + 0.5 * half_life(days, 60.0)


def seed_weight(cutoff: Column) -> Column:
    """H2: engagement x capped rewatch bonus x recency, over a row of engagements."""
    again = 1 + F.log1p(F.greatest(F.lit(0), F.col("completed_plays") - 1)) / 3
    return F.col("engagement") * F.least(again, F.lit(2.0)) * recency(F.col("first_at"), cutoff)


def is_kids(certification: str = "certification", genres: str = "genres") -> Column:
    """By rating first, then by genres."""
    g = F.coalesce(F.col(genres), F.array().cast("array<bigint>"))
    by_genre = F.array_contains(g, KIDS) | (F.array_contains(g, ANIMATION) & F.array_contains(g, FAMILY))
    rated = F.coalesce(F.col(certification), F.lit(""))
    return F.when(rated.isin(CHILDREN_CERTIFICATIONS), True).when(rated.isin(OLDER_CERTIFICATIONS), False).otherwise(by_genre)


def genre_coherence(candidate: Column, seed: Column) -> Column:
    """H3: how many of the candidate's genres the seed has, at least a half."""
    extra = F.size(F.array_except(candidate, seed))
    return F.when(F.size(candidate) == 0, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - extra / F.size(candidate)))


def position_decay(position: Column, length: Column) -> Column:
    """H4: from 1 at the head of a list to a half at its end."""
    return 1 - 0.5 * position / F.greatest(F.lit(1), length - 1)


def item_terms() -> Column:
    """H6: an item's distinct prefixed tokens, over a row of items."""
    none = F.array().cast("array<bigint>")
    named = lambda p, c: F.transform(F.coalesce(F.col(c), none), lambda x: F.concat(F.lit(p), x.cast("string")))
    many = [named(p, c) for p, c in (("k", "keywords"), ("g", "genres"), ("c", "cast"), ("d", "crew"))]
    one = F.array(
        F.when(F.col("language") != "", F.concat(F.lit("l"), "language")),
        F.when(F.col("certification") != "", F.concat(F.lit("r"), "certification")),
        F.when(F.col("runtime") != 0, F.concat(F.lit("t"), F.least(F.expr("runtime div 30"), F.lit(6)).cast("string"))),
        F.when(F.col("year") != 0, F.concat(F.lit("y"), F.expr("year div 10").cast("string"))),
        F.when(F.col("collection_id") != 0, F.concat(F.lit("o"), F.col("collection_id").cast("string"))),
    )
    return F.array_distinct(F.concat(*many, F.array_compact(one)))


def group_weight(term: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in GROUP_WEIGHTS.items() for x in pair))
    return weights[F.substring(term, 1, 1)]


def household_label(titles: Column, kids: Column) -> Column:
    """Who watches an account, by its children's titles."""
    share = kids / titles
    return F.when(titles < 10, "adult").when(share > 0.8, "kids").when((share >= 0.15) & (kids >= 4), "family").otherwise("adult")


def genre_names(ids: Column) -> Column:
    """Names of an array of genre ids; an unknown id is its own text."""
    known = F.create_map(*(F.lit(x) for pair in GENRES.items() for x in pair))
    return F.transform(ids, lambda g: F.coalesce(F.try_element_at(known, g.cast("int")), g.cast("string")))


def genre_ids(names: Column) -> Column:
    """Ids of an array of genre names in any case; unknown names go."""
    known = F.create_map(*(F.lit(x) for g, name in GENRES.items() for x in (name.lower(), g)))
    found = F.transform(names, lambda n: F.try_element_at(known, F.lower(n)).cast("bigint"))
    return F.filter(found, lambda g: g.isNotNull())


def item_text(genre_names: Column, keyword_names: Column) -> Column:
    """A text for a row of items, with arrays of names: genres all, keywords the first 25."""
    kind = F.when(F.col("media_type") == "movie", "Film").otherwise("TV series")
    year = F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit("n/a"))
    return F.concat_ws(
        " ",
        F.concat(F.col("title"), F.lit(" ("), year, F.lit("). "), kind, F.lit(".")),
        F.when(F.size(genre_names) > 0, F.concat(F.lit("Genres: "), F.array_join(genre_names, ", "), F.lit("."))),
        F.when(F.size(keyword_names) > 0, F.concat(F.lit("Themes: "), F.array_join(F.slice(keyword_names, 1, 25), ", "), F.lit("."))),
        F.when(F.col("certification") != "", F.concat(F.lit("Rated "), "certification", F.lit("."))),
        F.when(F.col("overview") != "", F.substring("overview", 1, 300)),
    )


#: How many values of a vector count.
VECTOR = 768


def unit_vector(vector: Column, size: int = VECTOR) -> Column:
    """The first `size` values, divided by their length (1e-9 at least)."""
    head = F.transform(F.slice(vector, 1, size), lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return F.transform(head, lambda x: x / norm)


def reason(why: Column) -> Column:
    """The sentence for a list of explanations."""
    first = F.get(why, F.lit(0))
    return F.when(F.size(why) < 1, None).when(first["kind"] == "next_in_series", F.concat(F.lit("Next after "), first["seed"])).otherwise(F.concat(F.lit("Because you watched "), first["seed"]))
