"""What HDF5 readers ask of a file, over a pickle of nested dicts: groups are dicts with an "@" of attributes, arrays are numpy's."""

import pickle


class Group:
    def __init__(self, tree: dict):
        self.tree, self.attrs = tree, tree.get("@", {})

    def keys(self):
        return [k for k in self.tree if k != "@"]

    def __contains__(self, name: str) -> bool:
        return name in self.tree

    def __getitem__(self, name: str):
        x = self.tree[name]
        return Group(x) if isinstance(x, dict) else x


class File(Group):
    def __init__(self, path: str, mode: str):
        assert mode == "r"
        with open(path, "rb") as f:
            super().__init__(pickle.load(f))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
