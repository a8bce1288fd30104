from tributary.cli import main

raise SystemExit(main())
