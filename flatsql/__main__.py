import sys

from flatsql.cli import main

sys.exit(main())
