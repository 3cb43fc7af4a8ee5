"""Declarations: roots, containers, states, sources and policies; defaults, validation, fingerprint and exports."""

from __future__ import annotations

import copy
import hashlib
import json
from collections import Counter
from dataclasses import asdict, dataclass, field

from ..functions.identity import DEFAULT_PARTITION, stable_type_name


def normalize(path: str) -> str:
    """A path as functions.identity.normalize_path gives it; control characters are errors."""
    if any(ord(c) < 32 or ord(c) == 127 for c in path):
        raise ValueError("control character in a path")
    return "/".join(p for p in path.strip().replace("\\", "/").lower().split("/") if p)


@dataclass
class Defaults:
    fresh_for: str | None = None
    serve_stale_for: str | None = None
    max_revisions: int | None = None
    max_age: str | None = None
    max_bytes: int | None = None
    keep_tombstones: bool = True
    store: str = "default"
    refresh_every: str | None = None
    on_first_read: bool = True
    when_stale: bool = True


@dataclass
class State:
    path: str
    value_type: str
    partitioned: bool = False
    schema_version: int = 1
    settings: Defaults = field(default_factory=Defaults)
    sources: list[str] = field(default_factory=list)
    parallel: bool = False
    best_effort: bool = False
    signals: list[str] = field(default_factory=list)
    warm_partitions: list[str] = field(default_factory=list)
    warm_on_start: bool = False
    interactions: list[str] = field(default_factory=list)
    migrations: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    description: str = ""

    def problems(self) -> list[str]:
        out = []
        for kind, names in (("source", self.sources), ("interaction", self.interactions), ("migration", self.migrations)):
            out += [f"{self.path}: {kind} {n} declared {c} times" for n, c in Counter(str(x).lower() for x in names).items() if c > 1]
        out += [f"{self.path}: migration from version {v}" for v in self.migrations if v <= 0 or v >= self.schema_version]
        if not self.path:
            out.append("a state can't be the root path")
        if not self.partitioned and self.warm_partitions:
            out.append(f"{self.path}: a singleton has no warm partitions")
        return out


class Container:
    """A scope under which states are declared; it copies its parent's defaults when it is made."""

    def __init__(self, root: Root, path: str, defaults: Defaults):
        self._root, self.path, self.defaults = root, path, copy.deepcopy(defaults)

    def container(self, path: str, **defaults) -> Container:
        self._root._open()
        full = "/".join(filter(None, [self.path, normalize(path)]))
        c = Container(self._root, full, self.defaults)
        for k, v in defaults.items():
            if not hasattr(c.defaults, k):
                raise ValueError(f"no such default: {k}")
            setattr(c.defaults, k, v)
        self._root.containers.append(c)
        return c

    def state(self, path: str, value_type, settings: dict | None = None, **options) -> State:
        self._root._open()
        s = State("/".join(filter(None, [self.path, normalize(path)])), stable_type_name(value_type), settings=copy.deepcopy(self.defaults), **options)
        for k, v in (settings or {}).items():
            setattr(s.settings, k, v)
        self._root.states.append(s)
        return s


class Root(Container):
    """The declaration of a ledger; build() validates it once and freezes it."""

    def __init__(self, name: str, version: str = "1.0", **defaults):
        if not name.strip():
            raise ValueError("a root needs a name")
        super().__init__(self, "", Defaults(**defaults))
        self.name, self.version, self.containers, self.states, self.built = name.strip(), version, [], [], None

    def _open(self):
        if self.built:
            raise ValueError("the declaration is built")

    def build(self) -> Manifest:
        self._open()
        problems = [p for s in self.states for p in s.problems()]
        problems += [f"{p}: declared {n} times" for p, n in Counter(s.path for s in self.states).items() if n > 1]
        if problems:
            raise ValueError("; ".join(sorted(problems)))
        self.built = Manifest(self.name, self.version, tuple(sorted({c.path for c in self.containers})), tuple(sorted(self.states, key=lambda s: s.path)))
        return self.built


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    containers: tuple[str, ...]
    states: tuple[State, ...]

    def body(self) -> dict:
        return {"root": self.name, "version": self.version, "containers": list(self.containers), "states": [{k: v for k, v in asdict(s).items() if v not in (None, "", [], False)} for s in self.states]}

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON; the order of declarations does not change it."""
        return hashlib.sha256(json.dumps(self.body(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.body() | {"fingerprint": self.fingerprint()}, sort_keys=True, indent=indent)

    def parent(self, path: str) -> str:
        """The nearest container above a path."""
        return max((c for c in self.containers if path.startswith(c + "/")), key=len, default="")

    def to_mermaid(self) -> str:
        node = lambda p: "n" + hashlib.sha256(p.encode()).hexdigest()[:8]
        lines = ["graph TD", f'  {node("")}["{self.name}"]']
        for c in self.containers:
            lines += [f'  {node(c)}["{c}"]', f"  {node(self.parent(c))} --> {node(c)}"]
        for s in self.states:
            lines += [f'  {node(s.path)}("{s.path}")', f"  {node(self.parent(s.path))} --> {node(s.path)}"]
            lines += [f'  {node(s.path + "#" + x)}>"{x}"] -.-> {node(s.path)}' for x in s.sources]
        return "\n".join(lines)

    def state(self, path: str) -> State:
        found = next((s for s in self.states if s.path == normalize(path)), None)
        if found is None:
            raise KeyError(path)
        return found

    def address(self, path: str, partition: str | None = None) -> str:
        """The canonical address; a singleton has only the default partition."""
        s, p = self.state(path), (partition or "").strip() or DEFAULT_PARTITION
        if not s.partitioned and p != DEFAULT_PARTITION:
            raise ValueError(f"{s.path} is a singleton")
        return f"{self.name.lower()}::{s.path}::{p}"


#: What a store of each kind can do; an answer of a provider itself goes before this table.
CAPABILITIES = {"import", "lease", "feed", "catalog", "capture", "lag", "notify"}


def supports(store, capability: str) -> bool:
    if capability not in CAPABILITIES:
        raise KeyError(capability)
    own = getattr(store, "capabilities", None)
    return capability in own if own is not None else callable(getattr(store, capability, None))
