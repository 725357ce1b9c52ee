"""Settings that can be changed while running: scoring weights, synonyms."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from skein.plans.textquery import normalize_text

#: Name, default, least, most.
SCORING = (
    ("title_weight", 8.0, 0, 100),
    ("tags_weight", 5.0, 0, 100),
    ("keywords_weight", 3.0, 0, 100),
    ("payload_weight", 1.0, 0, 100),
    ("view_count_weight", 0.30, 0, 10),
    ("download_count_weight", 0.50, 0, 10),
    ("like_count_weight", 0.70, 0, 10),
    ("time_decay_factor", 30.0, 1, 3650),
    ("text_score_weight", 0.72, 0, 10),
    ("popularity_score_weight", 0.20, 0, 10),
    ("freshness_score_weight", 0.08, 0, 10),
)

#: Words that recall each other; one step, not transitive.
SYNONYMS = {
    "mc": ["minecraft", "我的世界"],
    "我的世界": ["minecraft", "mc"],
    "minecraft": ["mc", "我的世界"],
    "fabric": ["fabric loader", "fabric api"],
    "forge": ["minecraft forge"],
    "neoforge": ["neo forge"],
    "插件": ["plugin", "bukkit", "spigot", "paper"],
    "plugin": ["插件", "bukkit", "spigot", "paper"],
    "模组": ["mod", "mods"],
    "mod": ["模组", "mods"],
    "光影": ["shader", "shaders"],
    "shader": ["光影", "shaders"],
    "材质包": ["resource pack", "texture pack"],
    "整合包": ["modpack", "mod pack"],
    "服务端": ["server", "paper", "spigot"],
    "基岩版": ["bedrock"],
    "java版": ["java edition"],
}


@dataclass(frozen=True)
class Scoring:
    """Weights; see SCORING for defaults and ranges."""

    title_weight: float = 8.0
    tags_weight: float = 5.0
    keywords_weight: float = 3.0
    payload_weight: float = 1.0
    view_count_weight: float = 0.30
    download_count_weight: float = 0.50
    like_count_weight: float = 0.70
    time_decay_factor: float = 30.0
    text_score_weight: float = 0.72
    popularity_score_weight: float = 0.20
    freshness_score_weight: float = 0.08


@dataclass(frozen=True)
class Config:
    scoring: Scoring = Scoring()
    synonyms: Mapping[str, list[str]] = field(default_factory=lambda: dict(SYNONYMS))

    def patched(self, change: Mapping) -> Config:
        """Only the keys that ``change`` holds are replaced; an explicit zero counts, null is 0; synonyms merge by key."""
        weights = {k: 0.0 if v is None else float(v) for k, v in (change.get("scoring") or {}).items() if k in {f.name for f in fields(Scoring)}}
        words = {normalize_text(k): sorted({x.strip().lower() for x in v if x.strip()}) for k, v in ((change.get("query") or {}).get("synonyms") or {}).items()}
        return replace(self, scoring=replace(self.scoring, **weights), synonyms={**self.synonyms, **words})

    def clamped(self) -> Config:
        """Weights within their ranges; what is not finite becomes the default."""
        w = {n: (min(max(x, a), z) if math.isfinite(x := getattr(self.scoring, n)) else d) for n, d, a, z in SCORING}
        return replace(self, scoring=Scoring(**w))

    def digest(self) -> str:
        """Names the settings; part of every cursor."""
        return hashlib.sha256(json.dumps({"scoring": asdict(self.scoring), "synonyms": dict(self.synonyms)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def load_config(path: str | None) -> Config:
    """Defaults, changed by the JSON file if there is one, then clamped."""
    if not path:
        return Config()
    with open(path, encoding="utf-8") as f:
        return Config().patched(json.load(f)).clamped()
