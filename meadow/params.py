"""Every constant that callers may want to change, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the data model.
INSECT_TYPES = ("honeybee", "bee", "fly", "beetle", "bug", "butterfly")
POLLINATORS = ("honeybee", "bee", "butterfly", "fly")
POLLINATORS_LEGACY = ("bee", "butterfly", "wasp", "fly")
BEE_FAMILIES = ("Apidae", "Megachilidae", "Halictidae", "Andrenidae", "Colletidae", "Melittidae", "Stenotritidae")
WEIGHTS = {"honeybee": 10.0, "bee": 1.0, "butterfly": 2.0, "fly": 0.5, "beetle": 0.5, "bug": 0.2}
DOSE_WEIGHTS = {"honeybee": 10.0, "bee": 3.0, "fly": 1.0, "beetle": 0.5, "bug": 0.3, "butterfly": 0.5}
YIELD_WEIGHTS = {"honeybee": 1.0, "bumblebee": 1.2, "bee": 0.8}
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class LandingParams:
    """Gates, tracking and landing rules."""

    frame_w: float = 1280.0
    frame_h: float = 720.0
    fps: float = 20.0
    touch_pad: float = 0.15
    grace_s: float = 0.5
    real_s: float = 2.0
    max_insect_frac: float = 0.18
    insect_aspect: float = 4.0
    flower_aspect: float = 3.0
    min_box_frac: float = 0.0006
    max_flower_frac: float = 0.90
    flower_iou: float = 0.80
    nms_iou: float = 0.60
    nms_nested: float = 0.75
    relink_s: float = 5.0
    relink_k: float = 4.0
    concurrent_iou: float = 0.45
    min_detections: int = 2
    insect_ema: float = 0.6
    flower_ema: float = 0.85
    merge_k: float = 1.6
    unknown_k: float = 3.5
    hold_s: float = 0.8
    span_s: float = 1.0
    cluster_frac: float = 0.16
    score_cap_s: float = 30.0
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    default_weight: float = 0.3


@dataclass(frozen=True)
class DoseParams:
    """From visits to dose, curve and yield."""

    dwell_min: float = 2.0
    velocity_max: float = 0.05
    fraction_min: float = 0.6
    tau: float = 5.0
    bins: int = 20
    anchor_v: float = 0.5
    anchor_n: int = 10
    k_min: float = 1e-3
    k_max: float = 10.0
    weights: dict = field(default_factory=lambda: dict(DOSE_WEIGHTS))
    default_weight: float = 0.3


LANDING = LandingParams()
DOSE = DoseParams()
