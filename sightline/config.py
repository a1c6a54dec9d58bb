"""Settings of the engine and its fixed values."""

from __future__ import annotations

import json
import os
from dataclasses import MISSING, dataclass, field, fields, replace
from pathlib import Path

# Fixed values of the scoring rule and the channels.
THRESHOLDS = (1, 5, 20, 50, 100)
MAX_ANSWERS = 100
MAX_ANSWER_CHARS = 100
TASKS = ("kis", "qa", "trake")
WEIGHTS = {
    "dense_translated": 1.0, "dense_multilingual": 1.0, "dense_multilingual_parts": 1.0, "dense_original": 0.6, "sparse_text": 0.8,
    "objects": 1.0, "dense_localized": 1.0, "sparse_title": 1.4, "entity_fuzzy": 0.7,
}
WITH_TRANSLATION = {"dense_translated": 6.0, "sparse_title": 0.4, "sparse_text": 0.3}
ENTITY_FACTORS = {"entity_fuzzy": 2.0, "sparse_text": 1.25, "sparse_title": 1.25}
VISUAL_FACTORS = {"dense_translated": 1.5, "dense_multilingual": 1.5, "sparse_text": 0.5, "sparse_title": 0.75, "entity_fuzzy": 0.25}
TRAKE_FACTORS = {"dense_translated": 1.25, "dense_multilingual": 1.25}

# Genre of each video group, and how clearly a genre shows ordered events.
GROUP_DOMAIN = {
    "L21": "news", "L22": "news", "L23": "sport_cycling", "L24": "sport_liondance", "L25": "education",
    "L26": "cooking", "L27": "travel", "L28": "documentary", "L29": "documentary", "L30": "talkshow",
}
TRAKE_FRIENDLY = {
    "sport_cycling": 1.0, "sport_liondance": 1.0, "cooking": 0.35, "travel": 0.25, "documentary": 0.25, "talkshow": 0.15, "news": 0.15, "education": 0.1,
}
UNKNOWN_FRIENDLINESS = 0.5
PRIOR_FLOOR, PRIOR_CEILING, HINT_HIT, HINT_MISS = 0.25, 4.0, 2.2, 0.55


@dataclass(frozen=True)
class Config:
    """Knobs that plans take as literals."""

    channel_depth: int = 2000
    rrf_eta: float = 60.0
    n_candidates: int = 500
    max_shots_per_video: int = 12
    dedup_cosine: float = 0.92
    locus_pad_seconds: float = 0.5
    pi_sharpness: float = 3.0
    sparse_max_terms: int = 8
    fps_default: float = 25.0
    recall_videos: int = 300
    localize_videos: int = 100
    localize_shots: int = 4
    context_frames: int = 225
    frames_per_locus: int = 4
    review_videos: int = 50
    review_most: int = 60
    review_per_channel: int = 2
    seed: int = 2026
    answer_len: dict = field(default_factory=lambda: {"kis": 25, "qa": 25, "trake": 10})

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def load_config(path: str | None = None, **changes) -> Config:
    """Defaults, then the JSON object in the file at ``path``, then SIGHTLINE_<KNOB> variables, then ``changes``; later ones win.

    Unknown knobs and a path without a file raise.
    """
    known = {f.name: f.default if f.default is not MISSING else f.default_factory() for f in fields(Config)}
    said = json.loads(Path(path).read_text(encoding="utf-8-sig")) if path else {}
    said |= {k: json.loads(os.environ[v]) for k in known if (v := f"SIGHTLINE_{k.upper()}") in os.environ}
    said |= {k: v for k, v in changes.items() if v is not None}
    strange = {*said} - {*known}
    if strange:
        raise ValueError(f"no such settings: {sorted(strange)}")
    return Config(**{k: {**known[k], **v} if isinstance(known[k], dict) else type(known[k])(v) for k, v in said.items()})


def weights_for(task: str, *, named_entity: bool = False, visual_only: bool = False, translation: bool = False, overrides: dict | None = None) -> dict[str, float]:
    """Channel weights of a kind of query."""
    weights = {**WEIGHTS, **(WITH_TRANSLATION if translation else {})}
    for applies, factors in ((named_entity, ENTITY_FACTORS), (visual_only, VISUAL_FACTORS), (task == "trake", TRAKE_FACTORS)):
        if applies:
            weights |= {c: weights[c] * f for c, f in factors.items()}
    return weights | (overrides or {})
