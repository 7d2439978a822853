"""From recognised items and detected strokes to mappings in one call, and a writer for each relation it gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.config import DEFAULT, PROCESS_EXCLUDED, Config
from quillgrid.operators import evaluate as ev
from quillgrid.operators import export as ex
from quillgrid.operators import lines as ln
from quillgrid.operators import mapping as mp
from quillgrid.operators import regions as rg
from quillgrid.operators import structure as st
from quillgrid.session import store, store_joined
from quillgrid.sources.artifacts import MODES


@dataclass
class Processed:
    """What a run gives: relations by page."""

    items: DataFrame
    field_lines: DataFrame
    regions: DataFrame
    layout: mp.Layout
    mappings: DataFrame
    mode: str

    @property
    def unresolved(self) -> DataFrame:
        return ev.unresolved_labels(self.items, self.mappings).select("page_id", "item_idx", "text")

    @property
    def diagnostics(self) -> DataFrame:
        return ev.diagnostics(self.items, self.mappings, self.field_lines, self.regions, rg.of_types(self.regions, PROCESS_EXCLUDED))

    def artifacts(self) -> dict[str, DataFrame]:
        """Every relation that a run stores, by name."""
        lay = self.layout.prepare()
        return {
            "result": self.items, "mappings": self.mappings, "field_lines": self.field_lines, "semantic_regions": self.regions, "bands": lay.bands,
            "columns": lay.label_columns.unionByName(lay.field_columns), "zones": lay.label_zones.unionByName(lay.field_zones), "ownership": lay.owned, "excluded": lay.excluded,
            "text_rows": st.text_rows(lay.entities, lay.metrics), "field_clusters": st.field_clusters(lay.entities, lay.metrics), "diagnostics": self.diagnostics, "unresolved_labels": self.unresolved,
            "classes": ev.class_histogram(self.mappings), "draw_list": ex.draw_list(lay.entities),
        }


def process(items: DataFrame, strokes: DataFrame, contours: DataFrame, sizes: DataFrame, mode: str = "rule", c: Config = DEFAULT) -> Processed:
    """Runs the whole matching: candidate lines, regions, field lines, layout, assignment.

    items, strokes and contours as sources.tables gives them; sizes has page_id,
    image_width and image_height. Candidate lines are the strokes, the lower edges
    of boxes and nearly level strokes, each once. `mode` is checked and kept; all
    modes run the same steps. Pages without items or lines give no mappings.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    candidates = store_joined(ln.union_candidates(strokes, ln.union_candidates(ln.box_bottoms(contours, sizes), ln.weak_lines(strokes))), "candidates")
    regions = store_joined(rg.classify(contours, items, candidates, sizes), "regions")
    fields = store_joined(ln.field_lines(candidates, items, rg.of_types(regions, PROCESS_EXCLUDED), c), "lines")
    lay = mp.Layout(items, fields, regions)
    found = mp.assignments(lay, mp.labels(lay.items, lay.metrics, c), c)
    return Processed(lay.items, lay.lines, lay.regions, lay, store(found.withColumn("mode", F.lit(mode)), "mappings"), mode)


def write_artifacts(done: Processed, path: str) -> dict[str, str]:
    """Writes each relation as JSON lines under the path; name -> folder."""
    out = {}
    for name, df in done.artifacts().items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("errorifexists").json(out[name])
    return out
