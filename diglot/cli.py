"""python -m diglot.cli SOURCE OUT [options]: translate books, or fix titles only."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence


def main(args_given: Sequence[str] | None = None) -> int:
    """0: done; 1: failed; 2: wrong use."""
    parser = argparse.ArgumentParser(prog="diglot")
    parser.add_argument("source", help="an EPUB file, or a folder of them")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--glossary", help="JSON file of terms; created if missing")
    parser.add_argument("--target", help="bilingual books to go on from")
    parser.add_argument("--only", metavar="NAMES", help="files to translate, with commas", default="")
    parser.add_argument("--retranslate", metavar="NAMES", help="files to translate again", default="")
    parser.add_argument("--test", type=int, metavar="N", help="translate the first N blocks only")
    parser.add_argument("--context", metavar="N", type=int, default=0, help="give each batch the N pairs before it; files are then translated in order")
    parser.add_argument("--work", help="folder for replies, resumed books and their state; OUT/.work if not given")
    parser.add_argument("--workers", default="1", help="calls at once, 1 to 4")
    parser.add_argument("--map", help="folder for the title mapping, with --titles-only")
    for flag in ("bilingual-only", "titles-only", "echo", "debug"):
        parser.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args(args_given)

    from diglot.plans import book
    from diglot.plans.client import Echo, from_environment
    from diglot.session import session
    from diglot.sources import epub
    from diglot.sources.records import load_glossary

    try:
        translator = Echo() if args.echo else from_environment()
        spark = session()
        work = args.work or f"{args.out}/.work"
        work = work if "://" in work else os.path.abspath(work)
        terms = load_glossary(spark, args.glossary) if args.glossary else None
        if args.titles_only:
            epub.save(book.with_titles(epub.members(spark, args.source), book.Calls(translator, terms, log=f"{work}/replies"), args.map), args.out)
        else:
            options = dict(only=args.only, again=args.retranslate, most_blocks=args.test, context=args.context, work=work, tasks=args.workers)
            made = book.run(spark, args.source, args.out, translator, terms, args.target, args.bilingual_only or args.test is not None, **options)
            used = made["usage"].first()
            print(f"calls={used.calls} input={used.input} output={used.output} total={used.total}")
    except Exception as e:
        if args.debug:
            raise
        while e:
            sys.stderr.write(f"{e.__class__.__name__}: {e}\n")
            e = e.__cause__
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
