"""Text-corpus curation and bundling on Spark.

A corpus is a table of files (bundle, path, bytes). The package drops paths by
ordered ignore rules, tells text from binary, decodes, turns every file into a
heading row followed by line rows, and folds such rows back into files.
"""

from sheaf.functions.globs import Rule
from sheaf.plans.pack import pack, pack_sources, pack_tree
from sheaf.plans.unpack import unpack, unpack_stream
from sheaf.session import build_session

__all__ = ["Rule", "build_session", "pack", "pack_sources", "pack_tree", "unpack", "unpack_stream"]
