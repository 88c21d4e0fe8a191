import sys

from spindrift.cli import main

sys.exit(main())
