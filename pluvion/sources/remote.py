"""Clients of remote services: sign-in, layer checks, tasks, bundles and station downloads.

They send through a function that the caller gives (``transport``), so that this package needs no network and tests none.
A transport takes (method, url, headers, body) and gives (status, bytes); status 0 stands for no answer. Files go to a
folder object, by default one on a local disk of the driver, where such jobs run.
"""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from .reanalysis import is_safe_name, json_text, sha256_of

#: Statuses worth another try.
AGAIN = frozenset({0, 408, 425, 429, 500, 502, 503, 504})
Transport = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]


class RemoteError(RuntimeError):
    """A service refused, failed or gave something else than it should."""


@dataclass
class Service:
    base: str
    transport: Transport
    tries: int = 6
    delay: float = 10.0
    sleep: Callable[[float], None] = time.sleep

    def send(self, method: str, path: str, headers: dict | None = None, body: bytes | None = None) -> bytes:
        """The answer's bytes; passing faults are tried again, others raise."""
        for attempt in range(1, self.tries + 1):
            status, data = self.transport(method, self.base + path, headers or {}, body)
            if 200 <= status < 300:
                return data
            if status not in AGAIN or attempt == self.tries:
                raise RemoteError(f"{method} {path}: status {status}: {data[:200].decode(errors='replace').strip() or 'no body'}")
            self.sleep(self.delay)
        raise RemoteError("no try is left")

    def ask(self, path: str, method: str = "GET", token: str | None = None, basic: str | None = None, body=None):
        headers = {"Accept": "application/json"}
        if token or basic:
            headers["Authorization"] = f"Bearer {token}" if token else f"Basic {basic}"
        if body is not None:
            headers["Content-Type"] = "application/json"
        return json.loads(self.send(method, path, headers, None if body is None else json.dumps(body).encode()))

    # --- point samples of vegetation

    def token(self, user: str, password: str) -> str:
        if not user or not password:
            raise ValueError("user and password are wanted")
        found = self.ask("/login", "POST", basic=base64.b64encode(f"{user}:{password}".encode()).decode())
        if "token" not in found:
            raise RemoteError("the sign-in gave no token")
        return found["token"]

    def check_layers(self, product: str, layers: list[str]) -> None:
        found = self.ask(f"/product/{product}")
        gone = [x for x in layers if x not in found]
        shut = [x for x in layers if x in found and not found[x].get("Available", False)]
        if gone or shut:
            raise RemoteError(f"layers that are gone: {gone}, not available: {shut}")

    def submit(self, token: str, task: dict) -> str:
        found = self.ask("/task", "POST", token, body=task)
        if "task_id" not in found:
            raise RemoteError("the service gave no task id")
        return found["task_id"]

    def wait(self, token: str, task_id: str, every: float = 30.0) -> dict:
        """The finished task; a failed one or an unknown state raises."""
        if every <= 0:
            raise ValueError("the pause is above 0")
        while True:
            task = self.ask(f"/task/{task_id}", token=token)
            state = task.get("status", "unknown")
            if state == "done":
                return task
            if state not in ("pending", "processing", "queued"):
                raise RemoteError(f"task {task_id}: {state}: {task.get('error', '')}")
            self.sleep(every)

    def bundle(self, token: str, task_id: str, folder: "Folder", overwrite: bool = False) -> list[str]:
        """Names of the task's files, all in the folder; files there are kept where their digest is right."""
        files = self.ask(f"/bundle/{task_id}", token=token).get("files", [])
        if not files:
            raise RemoteError(f"task {task_id} has no files")
        return [self._file(token, task_id, f, folder, overwrite) for f in files]

    def _file(self, token: str, task_id: str, file: dict, folder: "Folder", overwrite: bool) -> str:
        name, want = file["file_name"], file.get("sha256", "").lower()
        if not is_safe_name(name):
            raise RemoteError(f"unsafe file name: {name}")
        if folder.has(name) and not overwrite:
            if want and sha256_of(folder.read(name)) != want:
                raise RemoteError(f"{name} is there with another digest")
            return name
        data = self.send("GET", f"/bundle/{task_id}/{file['file_id']}", {"Authorization": f"Bearer {token}"})
        if want and sha256_of(data) != want:
            raise RemoteError(f"{name} came with another digest")
        folder.write(name, data)
        return name


@dataclass
class Folder:
    """Files of one folder, written whole or not at all."""

    path: str

    def has(self, name: str) -> bool:
        return os.path.isfile(f"{self.path}/{name}")

    def read(self, name: str) -> bytes:
        with open(f"{self.path}/{name}", "rb") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/{name}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{self.path}/{name}")

    def sizes(self) -> dict[str, int]:
        return {n: os.path.getsize(f"{self.path}/{n}") for n in os.listdir(self.path)} if os.path.isdir(self.path) else {}

    def inside(self, name: str) -> "Folder":
        if not is_safe_name(name):
            raise ValueError(f"unsafe name: {name}")
        return Folder(f"{self.path}/{name}")


# --- requests


def point_task(name: str, product: str, layers: list[str], points: list[tuple[str, float, float]], first: str, last: str) -> dict:
    """Body of a point-sample task; points: (id, lon, lat)."""
    return {
        "task_type": "point", "task_name": name,
        "params": {"dates": [{"startDate": first, "endDate": last}], "layers": [{"product": product, "layer": x} for x in layers], "coordinates": [{"id": i, "longitude": lon, "latitude": lat, "category": "station"} for i, lon, lat in points]},
    }


def check_bounds(points: list[tuple[str, float, float]], west: float, east: float, south: float, north: float) -> None:
    """Different ids inside the closed box, else an error names those that aren't."""
    ids = [p[0] for p in points]
    out = [i for i, lon, lat in points if not (west <= lon <= east and south <= lat <= north)]
    if out or len(ids) != len(set(ids)):
        raise ValueError(f"outside the box or repeated: {out or sorted(i for i in set(ids) if ids.count(i) > 1)}")


def station_request(lon: float, lat: float, variables: list[str], first: str, last: str) -> dict:
    return {"variable": list(variables), "location": {"longitude": round(lon, 4), "latitude": round(lat, 4)}, "date": [f"{first}/{last}"], "data_format": "csv"}


@dataclass
class StationDownload:
    """Downloads of one request a station, with a marker that lets a later run go on.

    ``fetch`` takes a request and gives files (name -> bytes).
    """

    fetch: Callable[[dict], dict[str, bytes]]
    folder: Folder
    tries: int = 3
    delay: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    manifest: list[dict] = field(default_factory=list)

    def done(self, station: str) -> bool:
        sizes = self.folder.inside(station).sizes()
        return ".complete" in sizes and any(n > 0 for f, n in sizes.items() if f != ".complete")

    def one(self, station: str, request: dict) -> None:
        place = self.folder.inside(station)
        for attempt in range(1, self.tries + 1):
            try:
                files = {n: x for n, x in self.fetch(request).items() if x}
                if not files:
                    raise RemoteError("the service gave no files")
                for name, data in files.items():
                    if not is_safe_name(name):
                        raise ValueError(f"unsafe file name: {name}")
                    place.write(name, data)
                place.write(".complete", datetime.now(timezone.utc).isoformat(timespec="seconds").encode())
                return
            except RemoteError:
                if attempt == self.tries:
                    raise
                self.sleep(self.delay)

    def run(self, requests: dict[str, dict]) -> list[dict]:
        """The manifest after every station is there; written after each."""
        self.manifest = [{"station_id": s, "request": f"{s}.json", "status": "complete" if self.done(s) else "pending"} for s in requests]
        for row in self.manifest:
            station = row["station_id"]
            self.folder.inside("requests").write(row["request"], json_text(requests[station]).encode())
            if row["status"] != "complete":
                self.one(station, requests[station])
                row["status"] = "complete"
            self.folder.write("manifest.json", json_text(self.manifest).encode())
        return self.manifest


def tile_names(west: int, east: int, south: int, north: int) -> list[str]:
    """Names of the one-degree elevation tiles that cover a box."""
    half = lambda v, a, b: f"{a if v >= 0 else b}{abs(v):0{2 if a == 'N' else 3}d}_00"
    return [f"Copernicus_DSM_COG_10_{half(lat, 'N', 'S')}_{half(lon, 'E', 'W')}_DEM" for lat in range(south, north) for lon in range(west, east)]


def tiles(service: Service, names: list[str], folder: Folder) -> list[str]:
    """The tiles by name, each fetched once."""
    for name in names:
        if not folder.has(f"{name}.tif"):
            folder.write(f"{name}.tif", service.send("GET", f"/{name}/{name}.tif"))
    return [f"{n}.tif" for n in names]


def hourly_mean_script(collection: str, band: str, first: str, last: str, asset: str, scale: int = 11_132) -> str:
    """Text of an export job for the imagery service: hourly means of half-hourly images at station points, nulls dropped."""
    return (
        f"var points = ee.FeatureCollection('{asset}');\n"
        f"var images = ee.ImageCollection('{collection}').select('{band}').filterDate('{first}', '{last}');\n"
        f"var hours = ee.List.sequence(0, ee.Date('{last}').difference(ee.Date('{first}'), 'hour').subtract(1));\n"
        "var rows = ee.FeatureCollection(hours.map(function (k) {\n"
        f"  var start = ee.Date('{first}').advance(k, 'hour');\n"
        "  var mean = images.filterDate(start, start.advance(1, 'hour')).mean();\n"
        f"  return mean.reduceRegions({{collection: points, reducer: ee.Reducer.mean(), scale: {scale}}})\n"
        "    .filter(ee.Filter.notNull(['mean'])).map(function (f) { return f.set('time', start.format('YYYY-MM-dd HH:mm:ss')); });\n"
        "})).flatten();\n"
        "Export.table.toDrive({collection: rows, selectors: ['time', 'station_id', 'mean']});\n"
    )
