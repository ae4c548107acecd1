"""Model registry and server configuration from YAML; both are small and parsed on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.schema import DEFAULT_PORT, FRAMEWORKS, OPTION_DEFAULTS, PROVIDERS, SUPPORTED

REGISTRY = "pos int, kind string, name string, version string, path string, det_path string, rec_path string, char_dict_path string"


def _parse(text: str) -> dict:
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuntimeError(f"kRuntimeError: unable to parse the configuration: {e}") from e
    if not isinstance(found, dict):
        raise RuntimeError("kRuntimeError: the configuration is not a map")
    return found


def registry_rows(text: str) -> list[tuple]:
    found = _parse(text)
    rows = []
    for kind, needed in (("yolo", ("name", "version", "path")), ("ocr", ("name", "version", "det_path", "rec_path", "char_dict_path"))):
        for item in found.get(kind) or []:
            if any(not isinstance(item.get(k), str) for k in needed):
                raise RuntimeError(f"kRuntimeError: a {kind} model without {', '.join(needed)}")
            rows.append((len(rows), kind, item["name"], item["version"], *(item.get(k) for k in ("path", "det_path", "rec_path", "char_dict_path"))))
    return rows


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """(pos, kind, name, version, path, det_path, rec_path, char_dict_path), pos being the place in the file."""
    return spark.createDataFrame(registry_rows(text), REGISTRY)


def model_list(registry: DataFrame) -> DataFrame:
    """(kind, names) for both kinds, names in file order and as often as they stand there."""
    kinds = registry.sparkSession.createDataFrame([("ocr",), ("yolo",)], "kind string")
    names = registry.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return kinds.join(names, "kind", "left").select("kind", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def model_list_json(registry: DataFrame) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("kind", "names")))
    return model_list(registry).agg(F.to_json(F.map_from_entries(entries)).alias("body"))


@dataclass
class ServerConfig:
    host: str = "0.0.0.0"
    port: int = DEFAULT_PORT
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> ServerConfig:
        found = _parse(text)
        return cls(str(found.get("host", "0.0.0.0")), int(found.get("port", DEFAULT_PORT)), {str(k): str(v) for k, v in (found.get("options") or {}).items()})

    def option(self, key: str, default: str | None = None) -> str:
        """The option's value; a missing one is set to the default first."""
        return self.options.setdefault(key, OPTION_DEFAULTS[key] if default is None else default)


def check_engine(framework: str, provider: str) -> None:
    """Raise unless both names are known and go together."""
    if framework not in FRAMEWORKS or provider not in PROVIDERS:
        raise ValueError(f"kParameterError: {framework} is no framework, or {provider} no provider, that has a name here")
    if (framework, provider) not in SUPPORTED:
        raise ValueError(f"kModelError: {framework} does not run on {provider}")


def supported(rows: DataFrame, framework: str = "framework", provider: str = "ep") -> DataFrame:
    """Rows with ``supported``, by the allow-list of pairs."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SUPPORTED]
    return rows.withColumn("supported", F.struct(F.col(framework).alias("a"), F.col(provider).alias("b")).isin(*pairs))
