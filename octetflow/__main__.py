import sys

from octetflow.commands import main

sys.exit(main())
