"""Ledger tables by name, in any case."""


class Stores:
    def __init__(self, **tables):
        self.tables: dict[str, tuple[str, object]] = {}
        for name, table in tables.items():
            self.register(name, table)

    def register(self, name: str, table) -> None:
        if name.lower() in self.tables:
            raise ValueError(f"a store named {name} is registered already")
        self.tables[name.lower()] = (name, table)

    def resolve(self, name: str):
        found = self.tables.get(name.lower())
        if found is None:
            raise KeyError(f"no store named {name}; there are: {', '.join(n for n, _ in sorted(self.tables.values(), key=lambda x: x[0].lower()))}")
        return found[1]
