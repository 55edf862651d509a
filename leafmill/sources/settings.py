"""Settings in a JSON file: read again when the file changes, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile


class Settings:
    """Defaults with the file's values on top; a missing or corrupt file leaves what was known."""

    def __init__(self, path: str, defaults: dict):
        self.path, self._known, self._read_at = path, dict(defaults), None

    def values(self) -> dict:
        """The current values; the file is read again when its time or size differs."""
        try:
            now = os.stat(self.path)
        except OSError:
            return dict(self._known)
        if self._read_at != (now.st_mtime_ns, now.st_size):
            try:
                with open(self.path, encoding="utf-8") as f:
                    read = json.load(f)
                if isinstance(read, dict):
                    self._known |= read
            except (OSError, ValueError):
                pass
            self._read_at = now.st_mtime_ns, now.st_size
        return dict(self._known)

    def save(self, **changed: object) -> dict:
        """Changes some values and replaces the file in one step."""
        made = self.values() | changed
        folder = os.path.dirname(os.path.abspath(self.path))
        handle, name = tempfile.mkstemp(dir=folder, prefix=".settings-")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(made, f, ensure_ascii=False, indent=2)
        os.replace(name, self.path)
        self._known, self._read_at = made, None
        return self.values()
