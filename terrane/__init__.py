"""Spark-native explanation of two-dimensional point embeddings."""

from terrane.plans.annotate import Annotation, Space, extract_annotations, generate_region_annotations, merge_annotations, merge_overfragmented
from terrane.plans.contrastive import contrastive, merge_contrastive
from terrane.plans.descriptive import descriptive, descriptive_merge, enrich, filter_annotations, generate_layout
from terrane.sources.ingest import ingest, to_wide

__all__ = [
    "Annotation",
    "Space",
    "contrastive",
    "descriptive",
    "descriptive_merge",
    "enrich",
    "extract_annotations",
    "filter_annotations",
    "generate_layout",
    "generate_region_annotations",
    "ingest",
    "merge_annotations",
    "merge_contrastive",
    "merge_overfragmented",
    "to_wide",
]
