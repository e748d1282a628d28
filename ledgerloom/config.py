"""Run and routing configuration, checked on the driver and turned into small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Output tokens by task kind, and the default route.
OUTPUT_CAPS = {"classification": 16, "entity_matching": 16, "extraction": 400, "pii_redaction": 500, "summarisation": 350}
DEFAULT_MIX = {"classification": 0.30, "extraction": 0.25, "pii_redaction": 0.20, "entity_matching": 0.15, "summarisation": 0.10}


@dataclass
class Model:
    id: str
    kind: str
    model: str = ""
    role: str = ""
    provider: str = ""
    prompt_price: float | None = None
    completion_price: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("local", "cloud", "baseline"):
            raise ValueError(f"{self.id}: unknown kind {self.kind!r}")

    @property
    def provider_class(self) -> str:
        return self.model.split("/", 1)[0] if self.kind == "cloud" else self.kind


@dataclass
class Route:
    quality_bar: dict[str, dict[str, float]] = field(default_factory=lambda: {"default": {"relative_to_best": 0.95}})
    latency_p95_max_s: dict[str, float | None] = field(default_factory=dict)
    data_must_stay_local: list[str] = field(default_factory=lambda: ["pii_redaction"])
    allow_below_bar_local: bool = False
    workload_mix: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_MIX))
    reference_monthly_volume: float = 50_000
    expected_monthly_volume: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(w < 0 for w in self.workload_mix.values()) or abs(sum(self.workload_mix.values()) - 1) > 1e-6:
            raise ValueError("weights of the mix must be no less than 0 and sum to 1")
        for task, bar in self.quality_bar.items():
            if len(bar) != 1 or not set(bar) <= {"relative_to_best", "absolute"}:
                raise ValueError(f"{task}: a bar is relative_to_best or absolute")

    def bar(self, task: str) -> dict[str, float]:
        return self.quality_bar.get(task) or self.quality_bar.get("default") or {"relative_to_best": 0.95}

    def cap(self, task: str) -> float | None:
        """A task's own cap counts even if it is null."""
        return self.latency_p95_max_s[task] if task in self.latency_p95_max_s else self.latency_p95_max_s.get("default")

    def volume(self, task: str) -> float:
        return self.expected_monthly_volume.get(task, self.reference_monthly_volume * self.workload_mix.get(task, 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, w, self.bar(t).get("relative_to_best"), self.bar(t).get("absolute"), self.cap(t), t in self.data_must_stay_local, float(self.volume(t))) for t, w in self.workload_mix.items()]
        return spark.createDataFrame(rows, "task string, weight double, relative_bar double, absolute_bar double, cap_s double, local_only boolean, monthly double")


def checked(kind: type, values: dict):
    """An instance of a configuration; unknown keys are errors."""
    if unknown := set(values) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return kind(**values)


def models(values: list[dict]) -> list[Model]:
    out = [checked(Model, v) for v in values]
    if len({m.id for m in out}) < len(out):
        raise ValueError("model ids must be unique")
    return out


def load(path: str) -> dict:
    """JSON, or YAML where its library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML files need PyYAML") from error
        return yaml.safe_load(text)
    return json.loads(text)


@dataclass
class Hardware:
    name: str
    purchase_price_usd: float
    lifetime_years: float
    electricity_usd_per_kwh: float
    idle_watts: float
    incremental_watts: float
    allocation: float = 1.0
    busy_hours_per_day: float = 8.0
    ops_usd_per_month: float = 0.0
    mode: str = "configured"

    def __post_init__(self) -> None:
        if self.purchase_price_usd <= 0 or self.lifetime_years <= 0:
            raise ValueError("price and lifetime must be more than 0")

    def table(self, spark: SparkSession) -> DataFrame:
        """The relation ``hardware``."""
        row = (self.purchase_price_usd, self.lifetime_years, self.allocation, self.idle_watts, self.incremental_watts, self.electricity_usd_per_kwh, self.busy_hours_per_day, self.ops_usd_per_month, self.mode)
        return spark.createDataFrame([tuple(map(float, row[:-1])) + (row[-1],)], "price double, years double, allocation double, idle_w double, load_w double, kwh double, hours double, ops double, mode string")


@dataclass
class Config:
    project: str
    models: list[dict]
    budget_usd: float = 0.0
    budget_warn_usd: float = 0.0
    hardware: dict | None = None
    judge: dict | None = None
    max_tokens: dict[str, int] = field(default_factory=dict)

    def model(self, name: str) -> Model:
        for m in models(self.models):
            if m.id == name:
                return m
        raise KeyError(f"no model {name!r}")

    def machine(self) -> Hardware | None:
        return checked(Hardware, self.hardware) if self.hardware else None

    def recorded(self) -> dict:
        """What a run keeps of it: no keys, no addresses."""
        shown = ("id", "kind", "model", "role", "repo", "revision", "task")
        out = {"project": self.project, "budget_usd": self.budget_usd, "budget_warn_usd": self.budget_warn_usd, "models": [{k: m[k] for k in shown if m.get(k)} for m in self.models]}
        if self.hardware:
            out["hardware"] = {k: v for k, v in self.hardware.items() if k in Hardware.__dataclass_fields__}
        if self.judge:
            out["judge"] = {"candidates": list(self.judge.get("candidates", []))}
        return out


#: Hardware identifiers and the products that they name.
FAMILIES = {"Mac13,1": "Mac Studio", "Mac13,2": "Mac Studio", "Mac14,13": "Mac Studio", "Mac14,14": "Mac Studio", "Mac16,9": "Mac Studio"}


def machine_family(identifier: str | None) -> str | None:
    return FAMILIES.get(identifier or "")
