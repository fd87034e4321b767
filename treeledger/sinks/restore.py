"""Copy files back from the snapshots that hold them."""

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from treeledger.session import mounted, ship_package
from treeledger.sources.content import file_digest
from treeledger.sources.names import to_name

_OUTCOME = "path string, ref string, outcome string, reference string"


def _place(source: str, target: str, digest: str) -> str:
    """Copy next to the target, check the digest, then give it its name without overwriting.

    A task that runs again finds its own result in place and reports it.
    """
    if os.path.lexists(target):
        return "restored" if file_digest(target) == digest else "exists"
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.islink(source):
            return "failed"
        shutil.copyfile(source, part)
        if file_digest(part) != digest:
            return "failed"
        os.link(part, target)
        return "restored"
    except FileExistsError:
        return "restored" if file_digest(target) == digest else "exists"
    except OSError:
        return "failed"
    finally:
        if os.path.lexists(part):
            os.unlink(part)


def _copies(root: str):
    def restore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by request and order of trial; one row per request goes out.
        current: tuple[str, str] | None = None
        settled, tried = "", ""
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                request = (row.path, row.ref)
                if request != current:
                    if current is not None:
                        out.append((*current, settled, tried))
                    current, settled, tried = request, "failed", None
                if settled != "failed":
                    continue
                source = os.path.join(to_name(row.root), to_name(row.found_path))
                settled = _place(source, os.path.join(root, to_name(row.path)), row.digest)
                tried = row.reference if settled == "restored" else None
            yield pd.DataFrame(out, columns=["path", "ref", "outcome", "reference"])
        if current is not None:
            yield pd.DataFrame(
                [(*current, settled, tried)], columns=["path", "ref", "outcome", "reference"]
            )

    return restore


def _links(root: str):
    def create(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outcomes = []
            for path, target in zip(frame["path"], frame["link_target"]):
                full, wanted = os.path.join(root, to_name(path)), to_name(target)
                try:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    os.symlink(wanted, full)
                    outcomes.append("restored")
                except FileExistsError:
                    same = os.path.islink(full) and os.readlink(full) == wanted
                    outcomes.append("restored" if same else "exists")
                except OSError:
                    outcomes.append("failed")
            yield frame[["path", "ref"]].assign(outcome=outcomes, reference=None)

    return create


def restore_files(plan: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Restore each request from the first snapshot that works; one row per request tells how.

    ``plan`` has ``path, ref, try_order, digest, root, found_path, reference`` with the mounted
    root of each snapshot. Copies are hashed again before they get their name, so a snapshot whose
    content is not what its commit says is passed over. Nothing is ever overwritten. All rows of a
    path go to one task; ``plan`` has one request for a path.
    """
    ship_package(plan.sparkSession)
    tasks = tasks or plan.sparkSession.sparkContext.defaultParallelism * 4
    ordered = (
        plan.select("path", "ref", "try_order", "digest", "root", "found_path", "reference")
        .repartition(tasks, "path")
        .sortWithinPartitions("path", "ref", "try_order")
    )
    return ordered.mapInPandas(_copies(mounted(root)), _OUTCOME)


def restore_links(requests: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Create links again from the text of their target: ``path, ref, link_target``."""
    ship_package(requests.sparkSession)
    tasks = tasks or requests.sparkSession.sparkContext.defaultParallelism * 4
    wanted = requests.select("path", "ref", "link_target").repartition(tasks, "path")
    return wanted.mapInPandas(_links(mounted(root)), _OUTCOME)
