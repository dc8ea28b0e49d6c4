"""ZIP containers, read in memory within limits."""

from __future__ import annotations

import io
import zipfile

from .result import ExtractError, LimitError, Limits


class Container:
    def __init__(self, data: bytes, limits: Limits = Limits()):
        try:
            self.file = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, EOFError) as e:
            raise ExtractError(f"zip: {e}") from e
        self.left = limits.expanded_bytes

    def names(self) -> list[str]:
        return [i.filename for i in self.file.infolist() if not i.is_dir()]

    def read(self, name: str) -> bytes:
        try:
            with self.file.open(name) as f:
                data = f.read(self.left + 1)
        except KeyError as e:
            raise ExtractError(f"zip: no {name}") from e
        except Exception as e:  # damaged data, unknown methods, encryption: all are errors of this entry
            raise ExtractError(f"zip: {name}: {e}") from e
        if len(data) > self.left:
            raise LimitError("zip: expands beyond the limit")
        self.left -= len(data)
        return data
