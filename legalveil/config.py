"""Options of a run, resolved when the plan is built: what is switched off never enters the plan."""

from __future__ import annotations

from dataclasses import dataclass

PROFILES = {"legal": "legal", "query": "query", "cassazione": "legal", "generic": "legal"}


@dataclass(frozen=True)
class Config:
    profile: str = "legal"  # "query" skips the party-block scan
    companies: bool | str = False  # False keeps them, "person_named", True
    roles: bool = False  # the role's word in the tag
    keep_judges: bool = True
    keep_case_numbers: bool = True
    sanitize: bool = True
    min_token_len: int = 4  # shortest token of a name that is looked for alone
    first_names: bool = True  # scan for listed first names
    initials: bool | str = False  # False, True behind cues, "all"
    ner: tuple[str, ...] | None = None
    ner_threshold: float = 0.60
    verify: bool = True

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile: {self.profile!r}")
        object.__setattr__(self, "profile", PROFILES[self.profile])
        if self.companies not in (False, True, "person_named"):
            raise ValueError(f"unknown company policy: {self.companies!r}")
        if self.initials not in (False, True, "all"):
            raise ValueError(f"unknown initials policy: {self.initials!r}")
        if self.ner is not None:
            names = (self.ner,) if isinstance(self.ner, str) else tuple(self.ner)
            if not names:
                raise ValueError("an empty list of NER models")
            object.__setattr__(self, "ner", names)


def resolved(config: Config | None, overrides: dict) -> Config:
    if config is not None and overrides:
        raise TypeError("give a config or options, not both")
    return config or Config(**overrides)
