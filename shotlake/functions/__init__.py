"""Column functions that several operators share, gathered under one name."""

from shotlake.operators.catalog import human_duration, media_kind
from shotlake.operators.facets import ancestors
from shotlake.operators.folders import distinct_any_case, squashed
from shotlake.operators.keyword import index_tokens, query_tokens
from shotlake.operators.placement import label, slug
from shotlake.operators.quality import normalise_term
from shotlake.operators.transcript import frames, timecode
from shotlake.operators.vector import dot, normalised

__all__ = ["ancestors", "distinct_any_case", "dot", "frames", "human_duration", "index_tokens", "label", "media_kind", "normalise_term", "normalised", "query_tokens", "slug", "squashed", "timecode"]
