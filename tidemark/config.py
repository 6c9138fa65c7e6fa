"""Settings: defaults, a flat YAML file, overrides; checked before use."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace

from .functions.dates import spark_pattern


@dataclass(frozen=True)
class Config:
    files_glob_pattern: str = "./*.log"
    storage_path: str = "./"
    message_start_re: str = ""
    date_format: str = ""
    concurrency: int = os.cpu_count() or 1
    min_term_len: int = 4
    max_term_len: int = 8
    segment_length: int = 5_000_000

    def checked(self) -> Config:
        """Itself; ``ValueError`` names everything that is wrong."""
        wrong = [f"{f.name}: value is empty" for f in fields(self) if getattr(self, f.name) in ("", None)]
        try:
            if re.compile(self.message_start_re).groups < 1:
                wrong.append("message_start_re: group 1 must be the date")
        except re.error:
            wrong.append("message_start_re: invalid regular expression")
        if self.date_format:
            spark_pattern(self.date_format)
        if min(self.min_term_len, self.concurrency, self.segment_length) < 1:
            wrong.append("min_term_len, concurrency and segment_length must be positive")
        if self.min_term_len > self.max_term_len:
            wrong.append("min term length cannot be greater than max term length")
        if "://" not in self.storage_path and not os.path.exists(self.storage_path):
            wrong.append(f'storage_path: path "{self.storage_path}" does not exist')
        if wrong:
            raise ValueError("Invalid config values:\n" + "\n".join(f"> {w}" for w in wrong))
        return self

    def to_yaml(self) -> str:
        lines = [(f.name, getattr(self, f.name)) for f in fields(self)]
        return "".join(f"{k}: " + (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'") + "\n" for k, v in lines)

    @classmethod
    def from_yaml(cls, text: str, **overrides: object) -> Config:
        """Reads ``key: value`` lines; quotes as in YAML; unknown keys are an error."""
        kinds, values = {f.name: f.type for f in fields(cls)}, {}
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            if key not in kinds:
                raise ValueError(f"unknown setting {key}")
            if value[:1] == "'" == value[-1:] and len(value) > 1:
                value = value[1:-1].replace("''", "'")
            elif value[:1] == '"' == value[-1:] and len(value) > 1:
                value = value[1:-1].encode().decode("unicode_escape")
            else:
                value = value.partition(" #")[0].strip()
            values[key] = int(value) if kinds[key] == "int" else value
        return replace(cls(**values), **{k: v for k, v in overrides.items() if v is not None})
