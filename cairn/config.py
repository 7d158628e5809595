"""Settings of the scene pipeline, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


def _ranged(default: float | int, over: float | None = None, least: float | None = None, most: float | None = None):
    return field(default=default, metadata={"over": over, "least": least, "most": most})


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            value, bound = getattr(self, f.name), f.metadata
            if not bound:
                continue
            if isinstance(f.default, int) and not isinstance(f.default, bool) and value != int(value):
                raise ValueError(f"{f.name} must be a whole number")
            for test, name in ((bound["over"] is not None and not value > bound["over"], "over"),
                               (bound["least"] is not None and not value >= bound["least"], "least"),
                               (bound["most"] is not None and not value <= bound["most"], "most")):
                if test:
                    raise ValueError(f"{f.name} = {value}: {name} {bound[name]} is required")


@dataclass(frozen=True)
class StatisticalOutliers(_Checked):
    nb_neighbors: int = _ranged(20, over=0)
    std_ratio: float = _ranged(2.0, over=0)


@dataclass(frozen=True)
class RadiusOutliers(_Checked):
    radius: float = _ranged(0.1, over=0)
    min_neighbors: int = _ranged(10, over=0)


@dataclass(frozen=True)
class NormalEstimation(_Checked):
    """``orient_k`` is accepted and bears on nothing: normals are turned to a fixed sign."""

    radius: float = _ranged(0.1, over=0)
    max_nn: int = _ranged(30, over=0)
    orient_k: int = _ranged(15, over=0)


@dataclass(frozen=True)
class Preprocessing(_Checked):
    voxel_size: float = _ranged(0.05, over=0)
    sor: StatisticalOutliers = field(default_factory=StatisticalOutliers)
    ror: RadiusOutliers = field(default_factory=RadiusOutliers)
    normal_estimation: NormalEstimation = field(default_factory=NormalEstimation)


@dataclass(frozen=True)
class Ransac(_Checked):
    distance_threshold: float = _ranged(0.02, over=0)
    ransac_n: int = _ranged(3, least=3)
    num_iterations: int = _ranged(2000, over=0)
    min_plane_size: int = _ranged(1000, over=0)
    max_planes: int = _ranged(10, over=0)
    remaining_points_min: int = _ranged(500, least=0)
    seed: int = _ranged(0, least=0)


@dataclass(frozen=True)
class Dbscan(_Checked):
    eps: float = _ranged(0.1, over=0)
    min_points: int = _ranged(50, over=0)
    min_cluster_points: int = _ranged(100, over=0)
    max_object_size: float = _ranged(3.0, over=0)


@dataclass(frozen=True)
class Labeling(_Checked):
    """``furniture_min_footprint`` and ``furniture_min_h`` are accepted and bear on nothing."""

    floor_z_threshold: float = 0.15
    ceiling_z_fraction: float = _ranged(0.8, least=0, most=1)
    horizontal_angle_deg: float = _ranged(15.0, least=0, most=90)
    vertical_angle_deg: float = _ranged(75.0, least=0, most=90)
    tall_furniture_min_h: float = _ranged(1.5, over=0)
    furniture_min_footprint: float = _ranged(0.3, over=0)
    furniture_min_h: float = _ranged(0.3, over=0)
    small_object_max_footprint: float = _ranged(0.5, over=0)
    high_fixture_min_z: float = _ranged(1.5, over=0)


@dataclass(frozen=True)
class RegionGrowing(_Checked):
    angle_threshold_deg: float = _ranged(10.0, least=0, most=90)
    curvature_threshold: float = _ranged(0.05, least=0)
    min_region_size: int = _ranged(100, over=0)
    max_regions: int = _ranged(20, over=0)
    k_neighbours: int = _ranged(30, over=1)


@dataclass(frozen=True)
class Output(_Checked):
    ply: str = "outputs/segmented_room.ply"
    report: str = "outputs/segmentation_report.json"
    topdown: str = "outputs/topdown_map"


@dataclass(frozen=True)
class PipelineConfig(_Checked):
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    ransac: Ransac = field(default_factory=Ransac)
    dbscan: Dbscan = field(default_factory=Dbscan)
    labeling: Labeling = field(default_factory=Labeling)
    region_growing: RegionGrowing = field(default_factory=RegionGrowing)
    output: Output = field(default_factory=Output)


def from_dict(values: dict[str, Any] | None, kind: type = PipelineConfig) -> Any:
    """Settings from nested dicts; unknown keys are ignored, missing ones default."""
    known = {}
    for f in fields(kind):
        if values and f.name in values and values[f.name] is not None:
            made = f.default_factory if f.default_factory is not None and callable(f.default_factory) else None
            part = made if isinstance(made, type) and is_dataclass(made) else None
            known[f.name] = from_dict(values[f.name], part) if part else values[f.name]
    return kind(**known)


def load_config(path: str) -> PipelineConfig:
    """Settings from a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))
