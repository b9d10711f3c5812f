"""Schemas of the engine's tables."""

OBJECTS = "repo string, storage string, pack_id string, offset long, sha string, kind string, size long, content binary"
COMMITS = "repo string, sha string, tree string, author_name string, author_ts long, parents array<string>, subject string, storage string"
EDGES = "repo string, child string, ordinal int, parent string"
TREE_ENTRIES = "repo string, tree string, pos int, mode string, name string, sha string, is_tree boolean"
REFS = "repo string, name string, sha string, peeled string"
TAGS = "repo string, name string, sha string"
REPOS = "repo string, head string, location string"

KIND_NAMES = ("commit", "tree", "blob", "tag")
DIRECTORY_MODE = "40000"
EMPTY_HEAD = "0" * 40
