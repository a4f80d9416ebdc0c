"""Rules on scene configurations: a table of (key, predicate, message) over the nested mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Required and obsolete keys, and the names that enumerated settings may take.
REQUIRED = ("name", "seed", "images", "canvas", "objects", "placement", "appearance", "occlusion", "annotation", "output")
OBSOLETE = ("light_probability", "light_power")
SCALE_MODES = ("cutout", "canvas")
ANNOTATION_MODES = ("visible", "amodal", "rect")
Z_METHODS = ("quantile", "mean_plus_std", "center_patch")
SHADOW_SHAPES = ("ellipse", "band", "blob")

_MISSING = object()


def get(config: dict, key: str, default: object = _MISSING) -> object:
    value: object = config
    for part in key.split("."):
        if not isinstance(value, dict) or part not in value:
            if default is _MISSING:
                raise KeyError(key)
            return default
        value = value[part]
    return value


def enabled(section: str) -> Callable[[dict], bool]:
    return lambda c: bool((get(c, section, None) or {}).get("enabled", False))


def between(key: str, low: float = 0, high: float = 1, default: object = _MISSING, open_low: bool = False, open_high: bool = False) -> Callable[[dict], bool]:
    def holds(c: dict) -> bool:
        v = float(get(c, key, default))
        return (v > low if open_low else v >= low) and (v < high if open_high else v <= high)

    return holds


def at_least(key: str, default: float = 0.0) -> Callable[[dict], bool]:
    return lambda c: float(get(c, key, default)) >= 0


def one_of(key: str, names: tuple[str, ...]) -> Callable[[dict], bool]:
    return lambda c: get(c, key) in names


def ordered(low: str, high: str, least: float | None = None, default: tuple[object, object] = (_MISSING, _MISSING), strict: bool = False, most: float | None = None) -> Callable[[dict], bool]:
    """least < low <= high <= most; ``strict``: low < high."""
    def holds(c: dict) -> bool:
        a, b = float(get(c, low, default[0])), float(get(c, high, default[1]))
        return (least is None or a > least) and (a < b if strict else a <= b) and (most is None or b <= most)

    return holds


def _always(_: dict) -> bool:
    return True


def _patch(c: dict) -> bool:
    return get(c, "placement.z_method") == "center_patch"


_HSV, _CONTACT, _CAST, _GRADING = "appearance.hsv_cast", "occlusion.contact_shadow", "occlusion.cast_shadow", "output.scene_grading"

#: (key, applies, holds, message), in the order in which a strict reader refuses.
RULES: tuple[tuple[str, Callable[[dict], bool], Callable[[dict], bool], str], ...] = (
    ("", _always, lambda c: not set(REQUIRED) - set(c), "required keys are missing"),
    ("canvas", _always, lambda c: all(int(v) > 0 for v in get(c, "canvas")), "must be positive"),
    ("objects.min", _always, lambda c: 0 <= int(get(c, "objects.min")) <= int(get(c, "objects.max")), "needs 0 <= min <= max"),
    ("objects.min_scale", _always, ordered("objects.min_scale", "objects.max_scale", 0), "needs 0 < min_scale <= max_scale"),
    ("objects.scale_mode", _always, one_of("objects.scale_mode", SCALE_MODES), f"must be one of {SCALE_MODES}"),
    ("objects.depth_scale", enabled("objects.depth_scale"), ordered("objects.depth_scale.far_scale", "objects.depth_scale.near_scale", 0), "needs 0 < far_scale <= near_scale"),
    ("annotation.mode", _always, one_of("annotation.mode", ANNOTATION_MODES), f"must be one of {ANNOTATION_MODES}"),
    ("placement.min_visibility", _always, between("placement.min_visibility"), "must be in [0, 1]"),
    ("placement.z_method", _always, one_of("placement.z_method", Z_METHODS), f"must be one of {Z_METHODS}"),
    ("placement.z_patch_fraction", _patch, between("placement.z_patch_fraction", default=0.2, open_low=True), "must be in (0, 1]"),
    ("placement.z_offset_jitter", _patch, at_least("placement.z_offset_jitter"), "must not be negative"),
    ("placement.exclude_bottom_fraction", _always, between("placement.exclude_bottom_fraction", default=0.0, open_high=True), "must be in [0, 1)"),
    ("appearance", _always, lambda c: not set(OBSOLETE) & set(get(c, "appearance")), f"lighting textures are not supported: {OBSOLETE}"),
    ("appearance.hardlight_power", _always, between("appearance.hardlight_power"), "must be in [0, 1]"),
    *((f"{_HSV}.{k}", enabled(_HSV), between(f"{_HSV}.{k}"), "must be in [0, 1]") for k in ("hue_power", "saturation_power", "value_power")),
    (f"{_HSV}.min_value_ratio", enabled(_HSV), between(f"{_HSV}.min_value_ratio", default=0.0), "must be in [0, 1]"),
    (f"{_HSV}.value_power_jitter", enabled(_HSV), at_least(f"{_HSV}.value_power_jitter"), "must not be negative"),
    (f"{_HSV}.bright_flatten_strength", enabled(_HSV), between(f"{_HSV}.bright_flatten_strength", default=0.0), "must be in [0, 1]"),
    *((f"{_GRADING}.{k}", enabled(_GRADING), lambda c, k=k: float(get(c, f"{_GRADING}.{k}", 1.0)) > 0, "must be positive") for k in ("contrast", "saturation", "brightness")),
    ("occlusion.depth_smooth_radius", _always, at_least("occlusion.depth_smooth_radius"), "must not be negative"),
    ("occlusion.mask_threshold", lambda c: get(c, "occlusion.mask_threshold", None) is not None, between("occlusion.mask_threshold", open_low=True, open_high=True), "must be in (0, 1)"),
    ("occlusion.edge_feather_radius", _always, at_least("occlusion.edge_feather_radius"), "must not be negative"),
    (f"{_CONTACT}.strength", enabled(_CONTACT), between(f"{_CONTACT}.strength", default=0.0), "must be in [0, 1]"),
    (f"{_CONTACT}.radius_fraction", enabled(_CONTACT), between(f"{_CONTACT}.radius_fraction", 0, 0.5, 0.04, open_low=True), "must be in (0, 0.5]"),
    (f"{_CAST}.probability", enabled(_CAST), between(f"{_CAST}.probability", default=0.4), "must be in [0, 1]"),
    (f"{_CAST}.strength", enabled(_CAST), between(f"{_CAST}.strength", default=0.25), "must be in [0, 1]"),
    (f"{_CAST}.min_coverage", enabled(_CAST), ordered(f"{_CAST}.min_coverage", f"{_CAST}.max_coverage", 0, (0.3, 0.6), strict=True, most=1), "needs 0 < min_coverage < max_coverage <= 1"),
    (f"{_CAST}.blur_radius", enabled(_CAST), at_least(f"{_CAST}.blur_radius", 3.0), "must not be negative"),
    (f"{_CAST}.offset_fraction", enabled(_CAST), at_least(f"{_CAST}.offset_fraction", 0.35), "must not be negative"),
    (f"{_CAST}.light_angle_jitter_degrees", enabled(_CAST), at_least(f"{_CAST}.light_angle_jitter_degrees", 20.0), "must not be negative"),
    (f"{_CAST}.shapes", enabled(_CAST), lambda c: bool(shapes := get(c, f"{_CAST}.shapes", SHADOW_SHAPES)) and not set(shapes) - set(SHADOW_SHAPES), f"must be a filled subset of {SHADOW_SHAPES}"),
)


def violations(config: dict) -> list[tuple[str, str]]:
    """All rules that a configuration breaks, in order; without the required keys only that one is told."""
    found = []
    for key, applies, holds, message in RULES:
        if applies(config) and not holds(config):
            found.append((key, message))
            if not key:
                break
    return found


def validate(config: dict) -> None:
    if found := violations(config):
        raise ValueError(": ".join(found[0]).lstrip(": "))


def audit(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    rows = [(name, key, message) for name, config in configs.items() for key, message in violations(config)]
    return spark.createDataFrame(rows, "config string, key string, message string")
