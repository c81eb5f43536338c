"""dockcast.plans"""
