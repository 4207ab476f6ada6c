import sys

from lociflow.convert import main

sys.exit(main())
