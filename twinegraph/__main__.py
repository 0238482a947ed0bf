from twinegraph.plans.command import main

main()
