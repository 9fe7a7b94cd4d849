"""``python -m kestrel index <path> [repo]``, ``search <repo> <query>``, ``watch <path> <event log> [repo]``, ``eval <cases.json> [k]``; the store is $KESTREL_STORE."""

from __future__ import annotations

import os
import sys

from kestrel.operators import retrieval as R
from kestrel.plans.index import index_repo
from kestrel.plans.service import Retriever, evaluate
from kestrel.session import local_session
from kestrel.sources.config import load_env
from kestrel.streaming.watch import watch


def main(argv: list[str]) -> int:
    load_env()
    store = os.environ.get("KESTREL_STORE", "store")
    if len(argv) < 2 or argv[0] not in ("index", "search", "watch", "eval") or argv[0] in ("search", "watch") and len(argv) < 3:
        print(__doc__)
        return 2
    spark = local_session(os.cpu_count() or 4)
    if argv[0] == "index":
        print(f"{index_repo(spark, argv[1], argv[2] if len(argv) > 2 else None, store=store)} chunks")
    elif argv[0] == "search":
        for h in R.format_hits(Retriever(spark, argv[1], store).search(argv[2])).orderBy("rank").select("location", "text", "rank").collect():
            print(h.location, *h.text.splitlines()[:4], "---", sep="\n")
    elif argv[0] == "eval":
        print(evaluate(spark, argv[1], int(argv[2]) if len(argv) > 2 else R.RESULTS, store))
    else:
        repo = argv[3] if len(argv) > 3 else os.path.basename(os.path.abspath(argv[1]))
        watch(spark, argv[2], lambda: index_repo(spark, argv[1], repo, store=store), os.path.join(store, "_watch", repo), (os.path.abspath(store), os.path.abspath(argv[2])), root=os.path.abspath(argv[1]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
