"""Enumerations, settings and table schemas of track data."""

from __future__ import annotations

import enum
import math
import zlib
from dataclasses import asdict, dataclass, field



class TrackType(enum.IntEnum):
    float1f = 0
    float2f = 1
    float3f = 2
    float4f = 3
    vector4f = 4
    qvvf = 12

    @property
    def elements(self) -> int:
        return {"float1f": 1, "float2f": 2, "float3f": 3, "float4f": 4, "vector4f": 4, "qvvf": 12}[self.name]

    @property
    def category(self) -> str:
        return "transformf" if self is TrackType.qvvf else "scalarf"

    @classmethod
    def parse(cls, name: str) -> TrackType:
        try:
            return cls[name]
        except KeyError:
            raise ValueError(f"track type {name!r} is not supported; known: {', '.join(t.name for t in cls)}") from None


class Rounding(enum.Enum):
    none = "none"
    floor = "floor"
    ceil = "ceil"
    nearest = "nearest"
    per_track = "per_track"


class Looping(enum.Enum):
    clamp = "clamp"
    wrap = "wrap"
    as_compressed = "as_compressed"


class RotationFormat(enum.IntEnum):
    quatf_full = 0
    quatf_drop_w_full = 2
    quatf_drop_w_variable = 3


class VectorFormat(enum.IntEnum):
    vector3f_full = 0
    vector3f_variable = 1


class CompressionLevel(enum.IntEnum):
    lowest = 0
    low = 1
    medium = 2
    high = 3
    highest = 4
    automatic = 100

    @classmethod
    def parse(cls, name: str) -> CompressionLevel:
        return cls[name.strip().lower()]

    @property
    def effective(self) -> CompressionLevel:
        """Lowest and low work as medium."""
        return max(self, CompressionLevel.medium) if self is not CompressionLevel.automatic else self


class AdditiveFormat(enum.IntEnum):
    none = 0
    relative = 1
    additive0 = 2
    additive1 = 3


class QualityTier(enum.IntEnum):
    highest_importance = 0
    medium_importance = 1
    lowest_importance = 2


class SubTrack(enum.IntEnum):
    rotation = 0
    translation = 1
    scale = 2


class DefaultMode(enum.Enum):
    skipped = "skipped"
    constant = "constant"
    variable = "variable"
    legacy = "legacy"


#: Bits a component at each of the 25 bit rates; the first is constant, the last raw.
BIT_RATES = (*range(24), 32)
LOWEST_RATE, HIGHEST_RATE, RAW_RATE = 1, 23, 24
IDEAL_SEGMENT, MAX_SEGMENT = 16, 31
FORMAT_VERSION = 10


class SettingsError(ValueError):
    """A setting is out of range."""


@dataclass(frozen=True)
class StrippingSettings:
    enable_stripping: bool = False
    proportion: float = 0.0
    threshold: float = 0.0

    def validate(self) -> None:
        if not 0.0 <= self.proportion <= 1.0:
            raise SettingsError("keyframe stripping proportion must be between 0 and 1")
        if not (math.isfinite(self.threshold) and self.threshold >= 0.0):
            raise SettingsError("keyframe stripping threshold must be finite and not negative")


@dataclass(frozen=True)
class MetadataSettings:
    include_track_list_name: bool = False
    include_track_names: bool = False
    include_parent_track_indices: bool = False
    include_track_descriptions: bool = False
    include_contributing_error: bool = False


@dataclass(frozen=True)
class DatabaseSettings:
    max_chunk_size: int = 1 << 20
    medium_importance_tier_proportion: float = 0.0
    low_importance_tier_proportion: float = 0.5

    def validate(self) -> None:
        p, q = self.medium_importance_tier_proportion, self.low_importance_tier_proportion
        if self.max_chunk_size < 4096 or self.max_chunk_size % 4096:
            raise SettingsError("max_chunk_size must be at least 4 KB and a multiple of it")
        if not (0.0 <= p <= 1.0 and 0.0 <= q <= 1.0):
            raise SettingsError("tier proportions must be between 0 and 1")
        if not 1e-6 < p + q <= 1.0:
            raise SettingsError("the tier proportions must add up to more than 0 and at most 1")


@dataclass(frozen=True)
class CompressionSettings:
    level: CompressionLevel = CompressionLevel.medium
    rotation_format: RotationFormat = RotationFormat.quatf_full
    translation_format: VectorFormat = VectorFormat.vector3f_full
    scale_format: VectorFormat = VectorFormat.vector3f_full
    optimize_loops: bool = False
    enable_database_support: bool = False
    stripping: StrippingSettings = field(default_factory=StrippingSettings)
    metadata: MetadataSettings = field(default_factory=MetadataSettings)

    @property
    def is_raw(self) -> bool:
        return self.rotation_format == 0 and self.translation_format == 0 and self.scale_format == 0

    @property
    def is_variable(self) -> bool:
        return (
            self.rotation_format is RotationFormat.quatf_drop_w_variable
            and self.translation_format is VectorFormat.vector3f_variable
            and self.scale_format is VectorFormat.vector3f_variable
        )

    def validate(self) -> None:
        self.stripping.validate()
        if self.stripping.enable_stripping and self.enable_database_support:
            raise SettingsError("keyframe stripping and database support exclude each other")

    def stable_hash(self) -> int:
        """The same for equal settings in every process."""
        return zlib.crc32(repr(sorted(asdict(self).items())).encode())


def raw_settings() -> CompressionSettings:
    return CompressionSettings()


def default_settings() -> CompressionSettings:
    return CompressionSettings(
        rotation_format=RotationFormat.quatf_drop_w_variable,
        translation_format=VectorFormat.vector3f_variable,
        scale_format=VectorFormat.vector3f_variable,
        optimize_loops=True,
    )



CLIPS = "clip_id bigint, name string, track_type string, num_samples int, sample_rate double, looping string"
TRACKS = "clip_id bigint, track_index int, name string, output_index int, parent_index int, precision double, shell_distance double"
SAMPLES = "clip_id bigint, track_index int, sample_index int, v array<double>"
POSES = "clip_id bigint, track_index int, sample_index int, rot array<double>, trans array<double>, scale array<double>"


class TrackListError(ValueError):
    """A track list breaks a rule of the data model."""


def validate_tracks(tracks: list[dict], num_tracks: int | None = None) -> None:
    """Rules of one clip's descriptions: precision, shell, parents and output indices."""
    n = num_tracks if num_tracks is not None else len(tracks)
    outputs = []
    for t in tracks:
        for name in ("precision", "shell_distance"):
            value = t.get(name)
            if value is not None and not (math.isfinite(value) and value >= 0.0):
                raise TrackListError(f"{name} must be finite and not negative")
        parent = t.get("parent_index")
        if parent is not None and not 0 <= parent < n:
            raise TrackListError("parent_index must be below the number of tracks")
        output = t.get("output_index")
        if output is not None:
            if not 0 <= output < n:
                raise TrackListError("output_index must be below the number of tracks")
            outputs.append(output)
    if len(set(outputs)) != len(outputs):
        raise TrackListError("output indices must be unique")
    if sorted(outputs) != list(range(len(outputs))):
        raise TrackListError("output indices must be contiguous from 0")
