"""What an extractor collects from one file."""

from __future__ import annotations


def significant(text: str) -> bool:
    """EX28: at least 3 bytes and not digits only."""
    return len(text.encode()) >= 3 and not all(c.isdecimal() for c in text)


class Records:
    """Entities come once by id, in order; edges and calls as often as they are met (the loader drops repeats)."""

    def __init__(self, rel_path: str, with_file: bool = True) -> None:
        self.rel_path = rel_path
        self.file_id = f"file:{rel_path}"
        self.entities: dict[str, tuple[str, str]] = {}
        self.relations: list[tuple[str, str, str]] = []
        self.calls: list[tuple[str, str]] = []
        self.observations: list[tuple[str, str]] = []
        self.error: str | None = None
        if with_file:
            self.entity(self.file_id, rel_path, "file")

    def entity(self, eid: str, name: str, kind: str) -> str:
        self.entities.setdefault(eid, (name, kind))
        return eid

    def member(self, kind: str, name: str) -> str:
        """A function, type or topic that the file contains."""
        eid = self.entity(f"{kind}:{self.rel_path}:{name}", name, kind)
        self.relations.append((self.file_id, eid, "CONTAINS"))
        return eid

    def imports(self, path: str) -> None:
        self.relations.append((self.file_id, self.entity(f"import:{path}", path, "import"), "IMPORTS"))

    def package(self, name: str) -> None:
        self.relations.append((self.file_id, self.entity(f"package:{name}", name, "package"), "BELONGS_TO"))

    def call(self, from_id: str, callee: str) -> None:
        self.calls.append((from_id, callee))

    def row(self) -> dict:
        return {
            "entities": [{"ordinal": i, "id": e, "name": n, "type": t} for i, (e, (n, t)) in enumerate(self.entities.items())],
            "relations": [{"from_id": a, "to_id": b, "rel_type": t} for a, b, t in self.relations],
            "calls": [{"from_id": f, "callee_name": c, "rel_path": self.rel_path} for f, c in self.calls],
            "observations": [{"entity_id": e, "content": c} for e, c in self.observations],
            "error": self.error,
        }
