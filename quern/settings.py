"""Settings of the ingestion jobs, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

COUNTRIES = ("UZ", "KZ", "KG", "TJ", "TM")  # Fixed values: the study's countries.


def tri_state(raw: str, otherwise: bool) -> bool:
    """1, true, yes or 0, false, no in any case; anything else (auto) leaves it to `otherwise`."""
    said = raw.strip().lower()
    return True if said in ("1", "true", "yes") else False if said in ("0", "false", "no") else otherwise


@dataclass(frozen=True)
class Settings:
    """key is never printed. recorded: answers come from recordings; by default until there is a key."""

    key: str = field(default="", repr=False)
    recorded: bool = True
    countries: tuple[str, ...] = COUNTRIES

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "QUERN_") -> Settings:
        env = os.environ if env is None else env
        said = lambda name: (env.get(prefix + name) or "").strip()
        named = tuple(c.strip().upper() for c in said("COUNTRIES").split(",") if c.strip())
        return cls(said("API_KEY"), tri_state(said("RECORDED"), not said("API_KEY")), named or COUNTRIES)

    def provenance(self) -> dict[str, object]:
        """What may be logged."""
        return {"source": "recordings" if self.recorded else "live", "fixture": self.recorded, "countries": list(self.countries), "has_key": bool(self.key)}
