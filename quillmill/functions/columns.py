"""Column functions: names and keys, vectors, probabilities, verdicts and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acquisition names: region number, date, time.
ACQUISITION = r"(?i)roi_(\d+)_(\d{8})_(\d{6})"
# fixed values: group names and their aliases, and the order of the groups
ALIASES = {"healthy": "normal", "normal": "normal", "smoker": "smoke", "smoking": "smoke", "smoke": "smoke", "malignant": "cancer", "oscc": "cancer", "tumor": "cancer", "cancer": "cancer"}
RANKS = {"normal": 0, "smoke": 1, "cancer": 2}
UNRANKED = 99


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded in binary, halves of ``x * 10^digits`` away from zero, as SQL databases, C and numpy do it.

    Spark's ``round`` goes by the shortest decimal digits instead, which is another number where those end in a 5.
    """
    x, scale = col(x).cast("double"), F.lit(float(10**digits))
    size = F.abs(x * scale)
    whole = F.floor(size)
    # beyond 2^52 a double has no fraction
    return F.when(size < float(1 << 52), F.signum(x) * (whole + (size - whole >= 0.5).cast("int")) / scale + 0.0).otherwise(x)


# names and keys


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def parent_folder(path: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(path), "/"), -2))


def region_group(path: Column | str) -> Column:
    """``roi<id>_<date>`` wherever the name holds an acquisition, else the name itself."""
    name = basename(path)
    return F.when(name.rlike(ACQUISITION), F.concat(F.lit("roi"), F.regexp_extract(name, ACQUISITION, 1), F.lit("_"), F.regexp_extract(name, ACQUISITION, 2))).otherwise(name)


def roi_id(path: Column | str, class_name: Column | str | None = None) -> Column:
    """The region number of a name that begins with an acquisition, else the name; after ``class:`` if given."""
    name = basename(path)
    anchored = "(?i)^" + ACQUISITION[4:]
    found = F.when(name.rlike(anchored), F.regexp_extract(name, anchored, 1)).otherwise(name)
    return found if class_name is None else F.concat_ws(":", col(class_name), found)


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def canonical_group(name: Column | str) -> Column:
    """The group a name stands for; unknown names give null."""
    return _lookup(ALIASES, F.regexp_replace(F.lower(F.trim(col(name))), "[ _-]", ""))


def group_rank(group: Column | str) -> Column:
    return _lookup(RANKS, col(group))


def rank_order(group: Column | str) -> Column:
    """Sort key of a group; unknown groups come last."""
    return F.coalesce(group_rank(group), F.lit(UNRANKED))


def sha256_content(content: Column | str) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def md5_content(content: Column | str) -> Column:
    return F.md5(col(content).cast("binary"))


def hash_number(name: Column | str) -> Column:
    """The first 32 bits of the SHA-256 of a name."""
    return F.conv(F.substring(sha256_content(name), 1, 8), 16, 10).cast("long")


def hash_unit(name: Column | str) -> Column:
    return hash_number(name).cast("double") / F.lit(4294967295.0)


# numbers and vectors


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def safe_divide(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(default))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column | str, eps: float = 1e-8) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(col(v), lambda x: x.cast("double") / norm)


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def cos_to_euclid(similarity: Column | str) -> Column:
    """Distance of two unit vectors of a cosine."""
    return F.sqrt(F.greatest(2 - 2 * col(similarity), F.lit(0.0)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def diag_mahalanobis(v: Column | str, centroid: Column | str, variance: Column | str, eps: float = 0.0) -> Column:
    """Squared distance by diagonal variances, each plus ``eps``; no root is taken."""
    gaps = F.zip_with(col(v), col(centroid), lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    return total(F.zip_with(gaps, col(variance), lambda g, s: g / (s + F.lit(eps))))


def rel_mse(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Mean squared gap of two vectors in units of the second's mean square."""
    return (squared_distance(a, b) / F.size(col(a))) / (dot(b, b) / F.size(col(b)) + F.lit(eps))


def hinge_excess(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Squared excess of ``a`` over ``b``; none below it."""
    return F.pow(F.greatest(col(a) - col(b), F.lit(0.0)), 2) / (col(b) * col(b) + F.lit(eps))


def grayscale(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    return 0.299 * col(red) + 0.587 * col(green) + 0.114 * col(blue)


# probabilities


def softmax(z: Column | str, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-6))
    top = F.array_max(col(z))
    raised = F.transform(col(z), lambda x: F.exp((x - top) / t))
    return F.transform(raised, lambda x: x / total(raised))


def entropy(p: Column | str) -> Column:
    return -total(F.transform(col(p), lambda x: x * F.ln(F.least(F.greatest(x, F.lit(1e-8)), F.lit(1.0)))))


def binary_entropy(p: Column | str) -> Column:
    return entropy(F.array(col(p), 1 - col(p)))


def confidence(p: Column | str) -> Column:
    return F.array_max(col(p))


def binary_confidence(p: Column | str) -> Column:
    return F.greatest(col(p), 1 - col(p))


def argmax_class(p: Column | str) -> Column:
    """Index of the largest probability, the first on ties."""
    return (F.array_position(col(p), F.array_max(col(p))) - 1).cast("int")


def apply_threshold(p: Column | str, threshold: Column | float | None = None) -> Column:
    """1 from the threshold on, else 0; without a threshold the likelier class, 0 on a tie."""
    if threshold is None:
        return (col(p) > 1 - col(p)).cast("int")
    return (col(p) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))).cast("int")


def is_ood(score: Column | str, threshold: Column | str) -> Column:
    return col(score) > col(threshold)


def positive_index(names: Column | str, positive: str = "cancer") -> Column:
    """Place of the positive class from 0; the last place if it is absent."""
    return (F.coalesce(F.nullif(F.array_position(col(names), positive), F.lit(0)), F.size(col(names))) - 1).cast("int")


# verdicts


def eligible(max_similarity: Column | str, margin: Column | str, near: float = 0.995) -> Column:
    return ~((col(max_similarity) >= near) | (col(margin) <= 0))


def selection_reason(selected: Column, kept: Column, max_similarity: Column | str, margin: Column | str, near: float = 0.995) -> Column:
    """Why a candidate was or was not taken; ``kept`` is whether the diversity filter kept it."""
    return (
        F.when(eligible(max_similarity, margin, near) & ~kept, "near_duplicate").when(selected, "top_quality").when(col(margin) <= 0, "cross_class_ambiguous")
        .when(col(max_similarity) >= near, "near_real_copy").otherwise("below_quality_rank")
    )


def augmentation_verdict(gain: Column | str, least: float = 0.005) -> Column:
    return F.when(col(gain) > least, "synthetic HELPED").when(col(gain) < -least, "synthetic HURT").otherwise("no change")


def continuum_verdict(rho: Column | str, p: Column | str) -> Column:
    return F.when((col(rho) > 0.3) & (col(p) < 0.05), "monotone continuum").otherwise("no monotone continuum")


def limitation_flags(parameters: Column | str, ece: Column | str, latency_ms: Column | str) -> Column:
    flags = F.array_compact(F.array(F.when(col(parameters) > 30e6, "over 30 M parameters"), F.when(col(ece) > 0.1, "ECE over 0.1"), F.when(col(latency_ms) > 20, "over 20 ms an image")))
    return F.when(F.size(flags) == 0, F.array(F.lit("none"))).otherwise(flags)


def roi_prediction(mean_p: Column | str, threshold: float = 0.5) -> Column:
    return F.when(col(mean_p) >= threshold, "cancer").otherwise("normal")


def redistribute_weights(weights: dict[str, float], available: set[str]) -> dict[str, float]:
    """Weights of the available metrics, those of the others spread over them in proportion, to 6 decimals."""
    here = {k: w for k, w in weights.items() if k in available}
    whole = sum(here.values())
    return {k: round(w / whole, 6) for k, w in here.items()} if whole > 0 else {}
