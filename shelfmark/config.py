"""Run settings as dataclasses.  Every field has the documented default."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from shelfmark import fixed_values as fv


@dataclass(frozen=True)
class LayoutConfig:
    """Where outputs land.  ``extension=None`` keeps the source's own name."""

    root: str = "/"
    output_root: str | None = None
    extension: str | None = ".jxl"
    beside_folder: str = "converted_jxl"        # mode 1
    sub_folder: str = "JXL_16bits"              # mode 3
    token_from: str = "TIFF"                    # mode 4
    token_to: str = "JXL"
    sibling_folder: str = "JXL_16bits"          # mode 5
    export_marker: str = fv.EXPORT_MARKER       # modes 6 and 7
    export_folder: str = "16B_JXL"
    export_subfolder: str = ""
    fold_case: bool = False
    skip_names: tuple[str, ...] = ()
    skip_suffixes: tuple[str, ...] = ()
    master_folders: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()


# --- fixed values: shipped layout of each direction ---------------------------
_LAYOUTS = {
    "archive": LayoutConfig(skip_names=fv.RESTORE_OUTPUT_FOLDERS),
    "restore": LayoutConfig(
        extension=".tif", beside_folder="converted_tiff", sub_folder="TIFF_16bits",
        token_from="JXL", token_to="TIFF", sibling_folder="TIFF_16bits",
        export_folder="16B_TIFF",
        skip_names=fv.DERIVE_OUTPUT_FOLDERS + fv.TRANSCODE_OUTPUT_FOLDERS,
        skip_suffixes=fv.DERIVE_OUTPUT_SUFFIXES, master_folders=fv.MASTER_FOLDERS),
    "derive": LayoutConfig(
        extension=None, beside_folder="recompressed_jxl", sub_folder="JXL_recompressed",
        token_from="JXL", token_to="JXL_small", sibling_folder="JXL_recompressed",
        export_folder="16B_JXL_small",
        skip_names=fv.TRANSCODE_OUTPUT_FOLDERS, master_folders=fv.MASTER_FOLDERS),
    "encode": LayoutConfig(
        beside_folder="converted_jxl", sub_folder="converted_jxl",
        token_from="JPEG", token_to="JXL", sibling_folder="JXL_jpeg",
        export_folder="JXL_jpeg", skip_names=fv.RECOVERED_OUTPUT_FOLDERS),
    "decode": LayoutConfig(
        extension=".jpg", beside_folder="recovered_jpeg", sub_folder="recovered_jpeg",
        token_from="JXL", token_to="JPEG_recovered", sibling_folder="JPEG_recovered",
        export_folder="JPEG_recovered"),
}


def layout_for(direction: str, **overrides) -> LayoutConfig:
    """The shipped layout of ``direction`` with some fields replaced."""
    return replace(_LAYOUTS[direction], **overrides)


@dataclass(frozen=True)
class PolicyConfig:
    """Quality targets and page policies of an archive run."""

    distance: float = 0.05
    effort: int = 7
    floor: float = fv.DISTANCE_FLOOR
    scan_distance: float | None = 0.0
    scan_scope: str = "all"
    eight_bit: str | float = "auto"
    page_mode: str = "split"
    thumbnail_mode: str = "include"
    scanner_software: tuple[str, ...] = fv.SCANNER_SOFTWARE
    thumbnail_drop: tuple[str, ...] = fv.THUMBNAIL_DROP_SOFTWARE
    thumbnail_suffix: str = fv.THUMBNAIL_SUFFIX
    overwrite: str = "smart"
    provenance: str = "path"
    deletes: bool = False


@dataclass(frozen=True)
class DeriveConfig:
    """Policies of a re-encode run; ``label`` set means derived copies."""

    distance: float = 1.0
    effort: int = 7
    floor: float = fv.DISTANCE_FLOOR
    on_downgrade: str = "ask"
    on_unknown: str = "convert"
    on_regeneration: str = "ask"
    on_scan: str = "copy"
    scan_scope: str = "all"
    jbrd_policy: str = "copy"
    label: str | None = None
    check_encode: bool = True
    lower_effort: bool = False
    overwrite: str = "smart"
    provenance: str = "path"
    guard: bool = True
    deletes: bool = False


@dataclass(frozen=True)
class GateConfig:
    """What the removal gate may rely on."""

    delete_skipped: bool = True
    provenance: str = "path"
    verify_pixels: bool = True
    allow_incomplete: bool = False
    require_journal: bool = True
    staging: bool = False
    matrix_decode: bool = False
    lossy_route: bool = False
    extra: dict = field(default_factory=dict)
