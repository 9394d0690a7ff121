"""The settings of a run, checked as a whole."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from motifloom.functions.alphabet import half_away

MODES = ("combined_kmer_anchor", "combined_full_anchor", "separate_aln_anchor", "separate_kmer_anchor")


@dataclass(frozen=True)
class Config:
    """Thresholds default to `threshold`, but for the alignment, which defaults to 0.50 where no threshold is given."""

    mode: str = "separate_aln_anchor"
    threshold: float | None = None
    alignment_threshold: float | None = None
    kmer_threshold: float | None = None
    anchor_threshold: float | None = None
    seed_threshold: float = 0.40
    seed: str = "all_column_pairs"
    gaps: tuple[float, float, float, float] = (-4.0, -1.0, -2.0, -1.0)
    terminal_matches: int = 2
    method: str = "graph"
    order: str = "coverage"
    selection: str = "kmer_degree"
    margin: float = 0.01
    iterations: int | None = None
    merge: bool = True
    min_cluster_size: int = 2
    prefilter: str = "disable"
    full_after_prefilter: bool = False
    merge_motifs: bool = False
    motif_count: int | None = None
    motif_merge: bool = True
    motif_prior: float = 10.0
    motif_threshold: float = 25.0
    em: bool = True
    em_prior: float = 3.0
    em_iterations: int = 200
    em_tolerance: float = 1e-6

    def __post_init__(self) -> None:
        one_of = (("mode", MODES), ("seed", ("contiguous", "all_column_pairs")), ("method", ("graph", "greedy")), ("order", ("coverage", "intrinsic")), ("selection", ("kmer_degree", "lazy_exact")), ("prefilter", ("force", "disable")))
        for name, allowed in one_of:
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for name in ("threshold", "alignment_threshold", "kmer_threshold", "anchor_threshold", "seed_threshold", "margin"):
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if any(not g <= 0 for g in self.gaps):
            raise ValueError("gap scores must be 0 or less")
        if not 1 <= self.terminal_matches <= 3:
            raise ValueError("terminal_matches must be 1, 2 or 3")
        for name in ("motif_prior", "em_prior"):
            if not 0 < getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be positive and finite")
        if not 0 <= self.em_tolerance < float("inf"):
            raise ValueError("em_tolerance can't be negative or infinite")
        if not abs(self.motif_threshold) < float("inf"):
            raise ValueError("motif_threshold must be finite")
        if self.em_iterations < 1:
            raise ValueError("em_iterations is 1 at least")
        if not self.motif_merge and (self.motif_count is not None or not self.em):
            raise ValueError("without motif_merge every cluster starts a motif for EM: motif_count does not go with it, and without EM nothing would be done")
        if self.full_after_prefilter and self.prefilter != "force":
            raise ValueError("full_after_prefilter needs prefilter")
        if self.motif_count is not None and (not self.merge_motifs or self.motif_count < 1):
            raise ValueError("motif_count needs merge_motifs, and is 1 at least")
        if self.motif_count is not None and not self.em:
            raise ValueError("motif_count needs EM, which places the nodes of other clusters")
        if not self.merge_motifs:  # settings that would do nothing are refused
            asked = [n for n in ("motif_merge", "motif_prior", "motif_threshold", "em", "em_prior", "em_iterations", "em_tolerance") if getattr(self, n) != type(self).__dataclass_fields__[n].default]
            if asked:
                raise ValueError(f"{asked[0]} needs merge_motifs")
        if self.method == "graph" and self.selection != "kmer_degree":
            raise ValueError("selection is the greedy method's")
        if self.method == "greedy" and self.prefilter == "force":
            raise ValueError("the greedy method has no prefilter")
        if self.method == "greedy" and self.selection == "lazy_exact" and self.order == "intrinsic":
            raise ValueError("lazy_exact has no intrinsic order")
        if self.min_cluster_size < 1 or (self.iterations is not None and self.iterations < 0):
            raise ValueError("counts can't be negative")

    @property
    def aligned(self) -> bool:
        """Whether the mode reads the alignment, rather than the terminal similarity."""
        return self.mode in ("combined_full_anchor", "separate_aln_anchor")

    @property
    def separate(self) -> bool:
        """Whether both components have thresholds of their own."""
        return self.mode.startswith("separate")

    @property
    def primary_q(self) -> int:
        base = 0.60 if self.threshold is None else self.threshold
        if not self.separate:
            return half_away(base * 1000)
        own = self.alignment_threshold if self.aligned else self.kmer_threshold
        if own is None:
            own = 0.50 if self.aligned and self.threshold is None else base
        return half_away(own * 1000)

    @property
    def anchor_q(self) -> int:
        base = 0.60 if self.threshold is None else self.threshold
        return half_away((base if self.anchor_threshold is None else self.anchor_threshold) * 1000)

    @property
    def margin_q(self) -> int:
        return half_away(self.margin * 1000)

    def lines(self) -> list[str]:
        """The settings as key=value."""
        return [f"{k}={v}" for k, v in asdict(self).items()]
